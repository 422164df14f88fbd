"""Each operator against a brute-force version, and on awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from quire.llm import bpe_codec, circulant, decontamination, frames, jpeg, language_id, line_dedup, lm_scores, media, near_duplicates, queries, rans, substring_dedup, token_counts, token_files
from quire.llm.frames import pick

WORD = open(public_tokenizers.path("word_bpe_49k.json")).read()
PIECE = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TEXT int, `n.tokens` int, n_lines long, id string"
BLANK = [None, "", " ", "\n \n", "\t"]


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def awkward(spark, documents):
    """Nulls in every column, blank and long texts, ties and repeated rows, columns with clashing names."""
    some = list(documents.values())[:12]
    rows = [(i, t, "en" if i % 2 else None, "s", 1, i, None, 7, "x") for i, t in enumerate([*BLANK, *some, *some[:3], "a", "ab cd", "é 日本 😀 don't <|endoftext|>", "word " * 30_000, "ا" * 5_000])]
    rows += [rows[7], rows[7], (None, some[0], "en", None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in pick(df, {"doc_id": "doc_id", "text": "text"}).collect()]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(WORD)


def random_texts(n, seed):
    alphabet = [*"abcdeinthorsl'ABZ0129.,!<|>é ñßÀİΣσς日本😀́ \t\r\x1c²½ªÅ\n  ÷×", "<|endoftext|>", "'s", "É", "  "]
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]


# token counts


def test_token_counts(spark, awkward):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=PIECE)
    want = sorted(((d, len(t.encode()), n := len(library.encode(t)), n > 4096) for d, t in texts_of(awkward)), key=repr)
    assert rows_of(token_counts.token_counts(awkward, PIECE), "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_token_counts_of_odd_spacing():
    counter = token_counts.PieceCounter(PIECE)
    texts = [*random_texts(2_000, 1), " a", "a ", "\na", "a\n", "a \n b", "▁a ▁", "  ", "\n"]
    assert counter.splits
    assert counter.counts(texts) == [len(counter.library.encode(t)) for t in texts]


def test_frequent_pretokens_of_all_texts(spark):
    texts = [" ".join(f"w{i % (n + 1)}" for i in range(40)) for n in range(400)] + [None, "", "x" * 5_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    seen = Counter(w for t in texts for w in (t or "").split(" ") if w)
    best = sorted(seen, key=lambda w: (-seen[w], w))
    for entries in (5, 12, 30, 1_000):
        got = set(token_counts.frequent_table(docs, PIECE, "text", entries=entries))
        assert got == set(best[: len(got)]) and len(got) <= entries
        below = seen[best[entries]] if entries < len(best) else 1
        assert {w for w in best if seen[w] > 1.05 * below} <= got


def test_thinned_summaries_keep_frequent_words():
    rng, seen, all_seen = random.Random(4), Counter(), Counter()
    for _ in range(200):
        words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(200)]
        seen.update(words)
        all_seen.update(words)
        seen = token_counts.thinned(seen, 50)
        assert len(seen) <= 50
    assert {w for w, c in all_seen.items() if c > all_seen.total() / 50} <= set(seen)
    assert all(0 <= all_seen[w] - c <= all_seen.total() / 50 for w, c in seen.items())


# byte-pair encoding


def test_codec_equals_the_library(spark, awkward):
    own = bpe_codec.decode(bpe_codec.encode(awkward, WORD), WORD, digests=True)
    tokenizer, want = library(), []
    for d, t in texts_of(awkward):
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert rows_of(own, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_round_trip_equals_encode_and_decode(spark, awkward):
    ids = bpe_codec.encode(awkward, WORD)
    two = bpe_codec.decode(ids, WORD, keep=("doc_id", "n_tokens", "ids"), digests=True)
    assert rows_of(bpe_codec.round_trip(awkward, WORD), *two.columns) == rows_of(two, *two.columns)


def test_codec_texts(spark, awkward):
    ids = bpe_codec.encode(awkward, WORD)
    tokenizer = library()
    want = sorted(((d, tokenizer.decode(tokenizer.encode(t, add_special_tokens=False).ids, skip_special_tokens=False)) for d, t in texts_of(awkward)), key=repr)
    assert rows_of(bpe_codec.decode(ids, WORD), "doc_id", "text") == want


def test_encoding_of_random_texts():
    texts, tokenizer = random_texts(4_000, 2), library()
    ids, begins = bpe_codec.encode_array(WORD, pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[begins[i] : begins[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_few_long_words():
    from quire.llm import word_bpe

    rng, tokenizer, bpe = random.Random(9), library(), word_bpe.WordBpe(WORD)
    stems = ["under", "standing", "lion", "ess", "qx", "é", "中文", "the", "ab"]
    words = ["".join(rng.choice(stems) for _ in range(n)) for n in (1, 2, 3, 5, 400, 800, 2_000)] + ["a" * 3_000]
    many = words + ["".join(rng.choice(stems) for _ in range(rng.randint(1, 6))) for _ in range(2 * word_bpe.FEW_WORDS)]
    for batch in (words, many):
        for w, ids in zip(batch, bpe.encode_words(batch), strict=True):
            assert np.frombuffer(ids, "<i4").tolist() == tokenizer.encode(w, add_special_tokens=False).ids, w


def test_table_starts_afresh(monkeypatch):
    from quire.llm import piece_table
    from quire.llm.word_bpe import WordBpe

    monkeypatch.setattr(piece_table, "ENTRIES", 50)
    table, tokenizer = piece_table.PieceTable(WordBpe(WORD)), library()
    for k in range(10):
        texts = random_texts(40, k)
        ids, begins = table.encode(pa.array(texts))
        assert ids.tolist() == [x for t in texts for x in tokenizer.encode(t, add_special_tokens=False).ids]
        assert table.count < 3_000 and begins[-1] == len(ids)


#: Two words that one polynomial modulo 2 ** 64 does not tell apart.
POLYNOMIAL_TWINS = ("ababaaabbbaaaaabaaaaaaabababaabbbabababbabbabaabaaabbaaababaaaab", "aababbbaaababbaababbaabaaaaaaaaaabababaabaabaabaabbaabbaaaaaaaaa")


def test_words_of_one_hash_keep_their_ids(spark):
    tokenizer = library()
    for pair in (POLYNOMIAL_TWINS, POLYNOMIAL_TWINS[::-1]):
        text = " ".join(pair)
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert bpe_codec.encode_array(WORD, pa.array([text]))[0].tolist() == want
        docs = spark.createDataFrame([(5, text)], "doc_id long, text string")
        own = bpe_codec.decode(bpe_codec.encode(docs, WORD), WORD, digests=True).collect()
        assert [(r.n_tokens, r.ids_sha256) for r in own] == [(len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest())]
        files = token_files.round_trip(docs, WORD, end_id=1).collect()
        assert [(r.n_tokens, r.ids_crc32) for r in files] == [(len(want) + 1, zlib.crc32(np.array([*want, 1], "<u4").tobytes()))]


@pytest.mark.parametrize("hashes", (1, 7, 1_000))
def test_pieces_are_compared_by_bytes(monkeypatch, hashes):
    from quire.llm import piece_table, wordhash
    from quire.llm.word_bpe import WordBpe

    plain = wordhash.hashed
    monkeypatch.setattr(wordhash, "hashed", lambda *a: tuple(x % np.uint64(hashes) for x in plain(*a)))
    table, tokenizer = piece_table.PieceTable(WordBpe(WORD)), library()
    for k in range(4):
        texts = [*random_texts(60, k), " ".join(POLYNOMIAL_TWINS), "aaaaaaaa aaaaaaab aaaaaaaaa aaaaaaaab b" + "a" * 63]
        ids, _ = table.encode(pa.array(texts))
        assert ids.tolist() == [x for t in texts for x in tokenizer.encode(t, add_special_tokens=False).ids]


# language identification


def test_language_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in queries.op5_language_id(spark, sf_dir).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2]
    assert sorted(d for d, r in got.items() if r.held_out) == sorted(held)
    assert sum(got[d].lang_pred == truth[d] for d in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_of_awkward_rows(spark, awkward, empty):
    model = language_id.fit(awkward, "text", "lang", "doc_id")
    assert model.languages == ["en"]
    got = language_id.identify(awkward, model).collect()
    assert len(got) == awkward.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id is not None and r.doc_id < len(BLANK))
    none = language_id.fit(empty, "text", "lang", "doc_id")
    assert {r.lang_pred for r in language_id.identify(awkward, none).collect()} == {"und"}


def test_language_scores_are_naive_bayes():
    texts = ["the cat and", "der hund und", "the dog", "ein und"]
    labels = ["en", "de", "en", "de"]

    def grams(text):
        x = [c if c.isalpha() else " " for c in "  " + text.lower() + "  "]
        return [tuple(x[i : i + k]) for k in (1, 2, 3) for i in range(len(x) - 2) if any(c != " " for c in x[i : i + k])]

    counts = {lang: Counter(g for t, own in zip(texts, labels, strict=True) if own == lang for g in grams(t)) for lang in ("de", "en")}
    size = 1 << language_id.BUCKET_BITS
    weights = np.zeros((size, 2))
    for column, lang in enumerate(("de", "en")):
        for t, own in zip(texts, labels, strict=True):
            if own == lang:
                for buckets, _ in language_id.grams([t])[0]:
                    weights[:, column] += np.bincount(buckets, minlength=size)
        assert weights[:, column].sum() == sum(counts[lang].values())
    smooth = weights + language_id.SMOOTHING
    model = language_id.Model(["de", "en"], np.log(smooth / smooth.sum(axis=0)).astype(np.float32), np.log([0.5, 0.5]))
    names, scores = language_id.score(model, ["the hund and und"])
    logs = {lang: sum(math.log((counts[lang][g] + 0.5) / (sum(counts[lang].values()) + 0.5 * size)) for g in grams("the hund and und")) for lang in counts}
    best = max(logs, key=logs.get)
    assert names == [best]
    assert scores[0] == pytest.approx(1 / sum(math.exp((v - logs[best]) / language_id.TEMPER) for v in logs.values()), rel=1e-4)


# media


def test_media_round_trip(spark, awkward):
    got = media.features(media.store(awkward), pixels=False)
    want = []
    for d, t in texts_of(awkward):
        b = t.encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        want.append((d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert rows_of(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == sorted(want, key=repr)
    by_text = {}
    for r in got.collect():
        by_text.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.feature, r.media_bytes))
    assert all(len(x) == 1 for x in by_text.values())


def test_jpeg_of_zeros_and_noise():
    rng = random.Random(3)
    contents = [b"", b"\0" * 500, bytes(rng.randrange(256) for _ in range(9_000)), b"\xff" * 700, bytes(rng.choice([0] * 30 + [1, 255]) for _ in range(7_000)), b"x" + b"\0" * 40 + b"y" + b"\0" * 62 + b"z"]
    payloads = [jpeg.padded(c) for c in contents]
    files = jpeg.pack(payloads)
    assert [p for _, p, _ in jpeg.unpack(files)] == payloads
    assert [jpeg.pack([p])[0] for p in payloads] == files


def test_jpeg_thumbnail_is_the_dc_of_each_block():
    payload = bytes(range(256)) * 2
    image, _, small = jpeg.unpack(jpeg.pack([payload]))[0]
    assert (image.width, image.height) == (24, 24)
    assert small.ravel()[:8].tolist() == list(payload[::64])


def test_damaged_images(spark):
    good = jpeg.pack([jpeg.padded(b"hello")])[0]
    files = [good, good[:40], b"", b"GIF89a", good[:-30] + b"\xff\xd9", None]
    df = spark.createDataFrame(list(enumerate(files)), "doc_id long, media binary")
    got = {r.doc_id: r for r in media.features(df, keep=("doc_id",)).collect()}
    assert got[0].payload_bytes == 64 and got[0].error is None and bytes(got[0].payload).rstrip(b"\0") == b"hello"
    assert all(got[i].payload_bytes is None and got[i].error for i in (1, 2, 3, 4))
    assert got[5].error is None and got[5].payload_bytes is None


def drawn(width, height, planes, restart=0, separate=False, comment=None):
    """A baseline file of flat blocks. ``planes``: sampling factors and DC values (rows of blocks) of each component."""
    step, dc, ac = 4, jpeg.DC, jpeg.AC
    most = [max(p[k] for p in planes) for k in (0, 1)]

    def scan(parts):
        units = [-(-size // (8 * m)) for size, m in zip((width, height), most, strict=True)]
        if len(parts) == 1:
            h, v, values = parts[0]
            units, parts = [-(-(-(-size * own // m)) // 8) for size, own, m in zip((width, height), (h, v), most, strict=True)], [(1, 1, values)]
        out, bits, last, done = b"", "", [0] * len(parts), 0

        def closed():
            raw = int("1" + (bits + "1" * (-len(bits) % 8)), 2).to_bytes(len(bits) // 8 + (len(bits) % 8 > 0) + 1, "big")[1:] if bits else b""
            return raw.replace(b"\xff", b"\xff\0")

        for unit in range(units[0] * units[1]):
            if restart and unit and unit % restart == 0:
                out, bits, last, done = out + closed() + bytes([0xFF, 0xD0 + done % 8]), "", [0] * len(parts), done + 1
            y, x = divmod(unit, units[0])
            for c, (h, v, values) in enumerate(parts):
                for j in range(v):
                    for i in range(h):
                        row = values[min(y * v + j, len(values) - 1)]
                        value = row[min(x * h + i, len(row) - 1)]
                        d, last[c] = value - last[c], value
                        n = abs(d).bit_length()
                        bits += format(int(dc[2][n]), f"0{dc[3][n]}b") + (format(d if d > 0 else d + (1 << n) - 1, f"0{n}b") if n else "")
                        bits += format(int(ac[2][0]), f"0{ac[3][0]}b")
        return out + closed()

    segment = jpeg._segment
    file = b"\xff\xd8" + (segment(0xFE, comment) if comment else b"") + segment(0xDB, bytes([0, *[step] * 64]))
    frame = b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v, _) in enumerate(planes))
    file += b"\xff" + segment(0xC0, bytes([8, *height.to_bytes(2, "big"), *width.to_bytes(2, "big"), len(planes)]) + frame)
    file += segment(0xC4, b"\0" + dc[0] + dc[1]) + segment(0xC4, b"\x10" + ac[0] + ac[1])
    if restart:
        file += segment(0xDD, restart.to_bytes(2, "big"))
    order = [[c] for c in reversed(range(len(planes)))] if separate else [list(range(len(planes)))]
    for parts in order:
        file += segment(0xDA, bytes([len(parts), *[x for c in parts for x in (c + 1, 0)], 0, 63, 0])) + scan([planes[c] for c in parts])
    return file + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 3])
@pytest.mark.parametrize("factors, width, height, separate", [([(1, 1)], 20, 30, False), ([(2, 2), (1, 1), (1, 1)], 50, 41, False), ([(2, 1), (1, 1), (1, 1)], 33, 9, False), ([(1, 1)] * 3, 16, 16, False), ([(2, 2), (1, 1), (1, 1)], 50, 41, True), ([(1, 2), (2, 1), (1, 1)], 70, 70, False)])
def test_any_baseline_image(restart, factors, width, height, separate):
    rng, most = random.Random(width + restart), [max(f[k] for f in factors) for k in (0, 1)]
    planes = []
    for h, v in factors:
        across, down = -(-(-(-width * h // most[0])) // 8), -(-(-(-height * v // most[1])) // 8)
        planes.append((h, v, [[rng.randrange(-255, 256) for _ in range(across)] for _ in range(down)]))
    image, payload, small = jpeg.unpack([drawn(width, height, planes, restart, separate)])[0]
    assert (image.width, image.height, payload) == (width, height, None)
    assert small.tolist() == [[min(255, max(0, v * 4 // 8 + 128)) for v in row] for row in planes[0][2]]


def test_images_without_a_payload(spark):
    grey, colour = drawn(8, 8, [(1, 1, [[16]])], comment=b"a photo"), drawn(16, 16, [(2, 2, [[1, 2], [3, 4]]), (1, 1, [[9]]), (1, 1, [[-9]])])
    df = spark.createDataFrame([(1, grey), (2, colour), (3, colour), (4, grey.replace(b"\xff\xc0", b"\xff\xc2"))], "doc_id long, media binary")
    got = {r.doc_id: r for r in media.features(df, keep=("doc_id",)).collect()}
    assert (got[1].width, got[1].height, got[2].width, got[2].error) == (8, 8, 16, None)
    assert got[1].payload_bytes is None and got[1].payload is None and got[1].media_bytes == len(grey) and got[1].feature.startswith("8x8:")
    assert got[2].feature == got[3].feature and bytes(got[2].thumbnail) == bytes([128, 129, 129, 130])
    assert got[4].width is None and "baseline" in got[4].error


# token files


def brute_files(texts):
    tokenizer, start, out = library(), 0, {}
    for d, t in sorted(texts):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        out[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_token_files(spark, documents):
    docs = spark.createDataFrame([*documents.items(), (10_000, None), (10_001, "")], "doc_id long, text string")
    files = token_files.stored(token_files.write(docs, WORD, 1, file_tokens=3_000), "files")
    assert files.count() > 4
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read(files).collect()}
    assert got == brute_files([*documents.items(), (10_000, ""), (10_001, "")])


def test_token_files_of_awkward_rows(spark, awkward, empty):
    got = token_files.round_trip(awkward, WORD, 1).collect()
    assert len(got) == awkward.count()
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted((r.doc_id for r in got), key=lambda d: (d is not None, d))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:], strict=False))
    assert token_files.round_trip(empty, WORD, 1).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, rans.BLOCK, rans.BLOCK + 1, 50_000])
def test_range_coder(n):
    ids = np.minimum(49_407, np.random.default_rng(n).pareto(0.7, n) * 30).astype(np.int64)
    file = rans.parse(rans.compress(ids, np.array([5, 6]), np.array([n, 0])))
    assert np.array_equal(rans.decode_blocks(file), ids)
    if n > 2 * rans.BLOCK:
        assert np.array_equal(rans.decode_blocks(file, 1, 2), ids[rans.BLOCK : 2 * rans.BLOCK])


def test_range_coder_finds_damage():
    content = bytearray(rans.compress(np.arange(5_000) % 700, np.array([1]), np.array([5_000])))
    content[-len(content) // 4] ^= 1
    with pytest.raises(rans.Damaged):
        rans.decode_blocks(rans.parse(bytes(content)))
    with pytest.raises(rans.Damaged):
        rans.parse(bytes(content[: len(content) // 2]))


def test_frequencies_add_up():
    for counts in ([1], [1, 10**9], [1] * 65_536, [10**6] + [1] * 60_000):
        f = rans.frequencies(np.array(counts), 16 if len(counts) <= 32_768 else 18)
        assert f.min() >= 1 and f.sum() in (1 << 16, 1 << 18)


# near-duplicates


@pytest.mark.parametrize("few", [0, 100_000])
def test_spread_join(spark, monkeypatch, few):
    monkeypatch.setattr(frames, "FEW_ROWS", few)
    monkeypatch.setattr(frames, "HOT_ROWS", 10)
    left = [(i, None if i % 7 == 0 else "hot" if i % 3 else f"k{i % 40}") for i in range(300)]
    weights = Counter(k for _, k in left if k)
    right = [(k, n, k.upper()) for k, n in weights.items() if k != "k9"] + [("unused", 1, "UNUSED")]
    got = frames.spread_join(spark.createDataFrame(left, "id long, k string"), spark.createDataFrame(right, "k string, c long, name string"), ["k"], "c", frames.F.col("id"), len(left))
    known = {k: (n, name) for k, n, name in right}
    assert rows_of(got, "id", "k", "c", "name") == sorted(((i, k, *known.get(k, (None, None))) for i, k in left), key=repr)


#: Two words of 1,024 letters that no polynomial modulo a power of two tells apart.
TWINS = tuple("".join("ab"[(bin(i).count("1") + k) % 2] for i in range(1_024)) for k in (0, 1))


def test_words_of_equal_polynomials_differ():
    from quire.llm import wordhash

    w = wordhash.words(pa.array([*TWINS, "a" * 8, "a" * 9, "a" * 16, "a" * 64, "a" * 65, "A" * 8]))
    assert len(set(w.hashes.tolist())) == len(set(w.others.tolist())) == 8
    low = wordhash.words(pa.array(["AbC" * 9, "aBc" * 9, "É"]), lower=True)
    assert low.hashes[0] == low.hashes[1] and low.others[0] == low.others[1]
    texts = random_texts(3_000, 11)
    w = wordhash.words(pa.array(texts))
    words = [x for t in texts for x in re.findall(rb"[^\x20\x09-\x0D]+", t.encode())]
    assert len(words) == len(w.hashes) and len(set(words)) == len(set(w.hashes.tolist())) == len(set(w.others.tolist()))
    assert len(set(zip(words, w.hashes.tolist(), w.others.tolist(), strict=True))) == len(set(words))


def test_twin_words_are_not_copies(spark):
    texts = [(1, TWINS[0]), (2, TWINS[1]), (3, TWINS[0].upper()), (4, f"{TWINS[0]} x y z"), (5, f"{TWINS[1]} x y z")]
    got = near_duplicates.similar_components(spark.createDataFrame(texts, "doc_id long, text string"), size=4)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == sorted((d, *x) for d, x in brute_components(texts, 4).items())


def test_a_collision_makes_no_link(spark, monkeypatch):
    """With all words hashed alike, links still need equal words."""
    from quire.llm import wordhash

    w = wordhash.words(pa.array(["a b c d e", "f g h i j", "a b c d e"]), lower=True)
    same = [np.zeros(1, np.uint64)] * 3
    index = near_duplicates.Index([1, 2], [1, 2], same[:2], ["a b c d e", "f g h i j"], 4)
    assert index.linked("f g h i j", same[0], 3, 80, 100) == [2]
    assert index.linked("k l m n o", same[0], 3, 80, 100) == []
    monkeypatch.setattr(wordhash, "runs", lambda hashes, size: np.zeros(max(0, len(hashes) - size + 1), np.uint64))
    assert len(circulant.sets(w, 4)[0]) == 1


def test_recall_of_bands():
    """Pairs of sets at 0.8 or just above, of all sizes: none may be missed by all bands."""
    rng = np.random.default_rng(12)
    missed = pairs = 0
    for n in (5, 9, 20, 45, 100, 300, 900, 2_000):
        for _ in range(150):
            both = math.ceil(0.8 * n)
            values = np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64))
            own = int(rng.integers(both, n + 1))
            a, b = np.sort(values[:own]), np.sort(np.append(values[:both], values[own:n]))
            assert 100 * both >= 80 * (len(a) + len(b) - both)
            keys = circulant.bands(np.array([circulant.signature(a), circulant.signature(b)]))
            pairs += 1
            missed += not (keys[0] == keys[1]).any()
    assert pairs > 1_000 and missed == 0


def brute_components(texts, size, share=80, whole=100):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for d, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower))
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            both = len(sets[a] & sets[b])
            if both and whole * both >= share * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def copies(documents, n=120, seed=4):
    """Documents with exact copies, near copies and chains of near copies."""
    rng = random.Random(seed)
    texts = list(documents.items())[:n]
    number = 10_000
    for _, t in texts[:30]:
        words = t.split(" ")
        for _ in range(rng.randint(1, 6)):
            if rng.random() < 0.7 and words:
                for _ in range(max(1, len(words) // 60)):
                    words[rng.randrange(len(words))] = rng.choice(["zz", "qq", "xx"])
            texts.append((number, " ".join(words)))
            number += 1
    return texts


def test_near_duplicates(spark, documents, monkeypatch):
    texts = [*copies(documents), *((20_000 + i, t or "") for i, t in enumerate(BLANK)), (30_000, "one two"), (30_001, "ONE two"), (30_002, "one two three")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = sorted((d, *x) for d, x in brute_components(texts, 4).items())
    got = near_duplicates.similar_components(df, size=4)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=repr)
    # the same with pivots and homes dealt into many parts
    monkeypatch.setattr(frames, "BROADCAST_IDS", 0)
    monkeypatch.setattr(near_duplicates, "PIVOT_ROWS", 2)
    monkeypatch.setattr(near_duplicates, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(near_duplicates, "PROBE_ROWS", 2)
    got = near_duplicates.similar_components(df, size=4)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=repr)


@pytest.mark.parametrize("probes, shingles", [(1_000, 1 << 17), (7, 900)])
def test_near_duplicates_of_a_large_group(spark, monkeypatch, probes, shingles):
    """One text changed here and there, so that many copies are far from each other."""
    monkeypatch.setattr(near_duplicates, "PROBE_ROWS", probes)
    monkeypatch.setattr(near_duplicates, "BLOCK_SHINGLES", shingles)
    rng = random.Random(5)
    base = [rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(100)]
    texts = []
    for d in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        texts.append((d, " ".join(words)))
    got = near_duplicates.similar_components(spark.createDataFrame(texts, "doc_id long, text string"), size=4)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(((d, *x) for d, x in brute_components(texts, 4).items()), key=repr)


def test_near_duplicates_of_awkward_rows(spark, awkward, empty):
    got = near_duplicates.similar_components(awkward).collect()
    assert len(got) == awkward.count()
    known = {r.doc_id: r for r in got}
    assert all(known[i].component_id == i and known[i].n_shingles == 0 for i in range(len(BLANK)))
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    want = brute_components({d: t for d, t in texts_of(awkward) if d is not None}.items(), 5)
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in known.items() if d is not None} == want
    assert near_duplicates.similar_components(empty).count() == 0


def test_components_of_a_path(spark):
    from quire.llm.components import components

    links = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 1), 100: 100, 101: 100}


# passages


def brute_passages(texts, window):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t) for d, t in texts}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("block_words, broadcast", [(0, 0), (600, 0), (10**9, 1_000_000)])
def test_passages(spark, documents, monkeypatch, block_words, broadcast):
    monkeypatch.setattr(frames, "BROADCAST_IDS", broadcast)
    monkeypatch.setattr(frames, "FEW_ROWS", broadcast)
    monkeypatch.setattr(frames, "HOT_ROWS", 3 if block_words < 1_000 else 1_000)
    rng = random.Random(6)
    passages = [t.split(" ")[5:] for t in documents.values() if len(t.split(" ")) > 150][:6]
    texts = list(documents.items())[:60] + [(10_000 + i, t) for i, t in enumerate(list(documents.values())[:10])]
    for d in range(20_000, 20_060):
        p = rng.choice(passages)
        a = rng.randrange(40)
        cut = p[a : a + rng.randint(45, 100)]
        texts.append((d, " ".join([*(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(0, 70))), *cut, *(["same"] * rng.randint(0, 120)), *rng.choice(passages)[:52]])))
    texts += [(30_000 + i, t or "") for i, t in enumerate(BLANK)]
    got = substring_dedup.drop_passages(spark.createDataFrame(texts, "doc_id long, text string"), block_words=block_words)
    want = brute_passages(texts, 50)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept") == sorted(((d, *x) for d, x in want.items()), key=repr)
    assert sum(x[1] for x in want.values()) > 2_000
    assert all(r.n_removed == sum(s.stop - s.start for s in r.removed) for r in got.collect())


@pytest.mark.parametrize("block_words", [5_000, substring_dedup.BLOCK_WORDS])
def test_a_passage_of_thousands_of_documents(spark, block_words):
    """One passage in 5,000 documents, between words of their own or of a few others; some only begin it."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(70)]
    around = [[f"c{k}_{i}" for i in range(30)] for k in range(400)]
    texts = []
    for d in range(5_000):
        cut = passage[: rng.randint(49, 70)] if d % 7 == 0 else passage
        before = rng.choice(around) if d % 3 else [f"b{d}_{i}" for i in range(d % 40)]
        after = rng.choice(around) if d % 2 else [f"a{d}_{i}" for i in range(d % 30)]
        texts.append((d, " ".join([*before, *cut, *after])))
    texts += [(6_000, " ".join(["same"] * 9_000)), (6_001, " ".join(["same"] * 9_001)), (6_002, " ".join(["same"] * 49))]
    got = substring_dedup.drop_passages(spark.createDataFrame(texts, "doc_id long, text string").repartition(8), block_words=block_words)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept") == sorted(((d, *x) for d, x in brute_passages(texts, 50).items()), key=repr)


def test_stretches_are_cut_to_the_places_given(spark):
    """Only runs of neighbouring places under one anchor, in the text that the digest names."""
    words = "a b c d e f g h".split()
    d1, d2 = substring_dedup.halves([substring_dedup.digest([w.encode() for w in words])])[0].tolist()
    places = [(d1, d2, 4, 7), (d1, d2, 0, 7), (d1, d2, 1, 7), (d1, d2, 2, 8), (d1 + 1, d2, 3, 8)]
    rows = spark.createDataFrame([(1, " ".join(words), places), (1, "other text", places)], "id long, text string, places array<struct<d1: long, d2: long, start: long, anchor: long>>")
    got = substring_dedup.trimmed(rows, 3)
    assert sorted((r[0], r[1], r[2], bytes(r[3])) for r in got.select("first", "anchor", "n", "words").collect()) == [(0, 7, 4, b"a b c d"), (2, 8, 3, b"c d e"), (4, 7, 3, b"e f g")]
    one = substring_dedup.single(got, 3).select("first", "words").collect()
    assert sorted((r[0], bytes(r.words)) for r in one) == [(0, b"a b c"), (1, b"b c d"), (2, b"c d e"), (4, b"e f g")]


def test_a_twin_word_keeps_a_passage(spark):
    """Passages of 50 words that differ in one of two words with equal polynomials."""
    rest = " ".join(f"w{i}" for i in range(49))
    texts = [(1, f"{TWINS[0]} {rest}"), (2, f"{TWINS[1]} {rest}"), (3, f"x {TWINS[1]} {rest} y")]
    got = substring_dedup.drop_passages(spark.createDataFrame(texts, "doc_id long, text string"))
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept") == sorted((d, *x) for d, x in brute_passages(texts, 50).items())


def test_factors_are_compared_by_words():
    """All windows hash alike: only equal words make a factor, at the place where they stand."""
    block = substring_dedup.ReferenceBlock(3)
    parse = lambda d, text: block.factors(d, text.encode().split(), [0] * (len(text.split()) - 2))
    assert parse(1, "a b c d e") == [] and parse(1, "a b c") == []
    assert parse(2, "x b c d e y") == [(1, 1, 4)]
    assert parse(3, "q a b c d y") == [(0, 1, 4)]
    # over the end of one factor the next window is looked up anew
    assert parse(4, "b c d y d e y") == [(1, 0, 3), (20, 1, 3), (13, 4, 3)]


def test_passages_of_awkward_rows(spark, awkward, empty):
    got = substring_dedup.drop_passages(awkward)
    want = brute_passages({d: t for d, t in texts_of(awkward) if d is not None}.items(), 50)
    rows = got.collect()
    assert len(rows) == awkward.count()
    assert all(want[r.doc_id] == (r.n_words, r.n_removed, r.kept) for r in rows if r.doc_id is not None)
    assert all(r.n_removed == 0 for r in rows if r.doc_id is None)
    assert substring_dedup.drop_passages(empty).count() == 0


# benchmark


def changed(text, edits, rng):
    text = list(text)
    for _ in range(edits):
        at = rng.randrange(len(text))
        kind = rng.randrange(3)
        text[at : at + (kind > 0)] = [] if kind == 1 else [rng.choice("abcxyz")]
    return "".join(text)


def test_leaks(spark, sf_dir, documents):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    rng, planted, rows = random.Random(7), set(), []
    others = list(documents.values())
    for n, (i, t) in enumerate(items.items()):
        plain = re.sub(r"[\W_]+", " ", t.lower()).strip()
        for kind, passage in enumerate((t, t.upper().replace(" ", "\n"), changed(plain, len(plain) * 4 // 100, rng), plain[: 160 if len(plain) > 170 else len(plain)])):
            d = 100_000 + 10 * n + kind
            rows.append((d, f"{others[n][:300]} {passage} {others[n + 1][:200]}"))
            planted.add((d, i))
    docs = spark.createDataFrame([*documents.items(), *rows], "doc_id long, text string")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()}
    assert planted <= got
    exact = {(d, i) for d, t in documents.items() for i, b in items.items() if b in t}
    assert {x for x in got if x[0] < 100_000} == exact
    blocks = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench, block_chars=500).collect()}
    assert blocks == got
    clean = {r.doc_id for r in decontamination.clean(docs, bench, block_chars=2_000).collect()}
    assert clean == {*documents, *(d for d, _ in rows)} - {d for d, _ in got}


@pytest.mark.parametrize("length", [85, 120, 150, 300])
def test_passages_of_an_item_are_found_at_every_offset(length):
    rng = random.Random(length)
    words = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(100))
    item = words[: length - 1] + "q"
    made, size = decontamination.block([item]), 80
    texts = [f"0 {item[a : a + size]} 0" for a in range(length - size + 1)]
    assert {t for t, _, _ in decontamination.matches(made, texts)} == set(range(len(texts)))
    # a whole item keeps its own budget of edits besides
    k = min(length, 100) * 6 // 100
    spread = list(item[:100])
    for n in range(k):
        spread[(n * len(spread)) // k + 3] = "0"
    assert decontamination.matches(made, ["".join(spread) + item[100:]])


def brute_leaks(texts, items):
    """Every piece of every item against every text by a full table of edit distances."""
    plain = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    out = Counter()
    for d, text in texts:
        text = plain(text)
        code = np.array([ord(c) for c in text], np.int64)
        for i, item in items:
            item = plain(item)
            if len(item) < 20:
                if item and f" {item} " in f" {text} ":
                    out[d, i, 1, 1, 0] += 1
                continue
            size = min(60, len(item))
            pieces = [item[a : a + size] for a in [*range(0, len(item) - size, 21), len(item) - size]]
            found = []
            for piece in pieces:
                row = np.zeros(len(code) + 1, np.int64)
                for c in piece:
                    new = row + 1
                    new[1:] = np.minimum(new[1:], row[:-1] + (code != ord(c)))
                    steps = np.arange(len(new))
                    row = np.minimum.accumulate(new - steps) + steps
                if row.min() <= size * 6 // 100:
                    found.append(int(row.min()))
            if found:
                out[d, i, len(pieces), len(found), sum(found)] += 1
    return out


def test_leaks_equal_brute_force(spark, sf_dir):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()][:8]
    rng = random.Random(13)
    items += [(900, "forty two"), (901, "Yes!"), (902, "a b"), (903, "exactly nineteen ch"), (904, "just over twenty chars"), (905, "x" * 61), (906, "..."), (907, None), (901, "yes")]
    plain = [re.sub(r"[\W_]+", " ", (t or "").lower()).strip() for _, t in items]
    filler = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(0, 15)))
    texts = [(1, None), (2, ""), (3, "yes"), (4, "oh yes, forty-two"), (5, "yesterday forty twofold"), (6, "forty"), (7, "two yes forty two a"), (8, "b"), (9, "x A-b. y")]
    for d in range(10, 130):
        p = rng.choice(plain)
        a = rng.randrange(max(1, len(p) - 50))
        cut = p[a : a + rng.choice([30, 60, 80, 100, 400])]
        texts.append((d, f"{filler()} {changed(cut, rng.randint(0, min(5, len(cut) - 1)), rng) if cut else ''} {filler()}"))
    got = decontamination.leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute_leaks(texts, items)
    assert Counter(map(tuple, got.collect())) == want
    assert len(want) > 40 and {k[1] for k in want} >= {900, 901, 902}


def test_alignment_counts_edits():
    rng, text = random.Random(8), "".join(random.Random(9).choice("abcdefgh ") for _ in range(100))

    def distance(a, b):  # a against any stretch of b
        row = [0] * (len(b) + 1)
        for x in a:
            new = [row[0] + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    code = lambda s: np.array([ord(c) for c in s], np.uint32)
    for edits in range(9):
        before = "".join(rng.choice("uvw") for _ in range(rng.randrange(12)))
        region = before + changed(text, edits, rng) + "uuvv"
        got = decontamination._aligned([code(text)], [code(region)], np.array([len(before)]), np.array([6]), np.array([14]))
        assert got[0] == min(distance(text, region), 7)


def test_leaks_of_awkward_rows(spark, awkward, empty):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (None, "an item without a number that is long enough"), (4, "word " * 60), (4, "word " * 60)], "item_id long, text string")
    got = rows_of(decontamination.leaks(awkward, bench), "doc_id", "item_id")
    long_doc = [d for d, t in texts_of(awkward) if t.startswith("word word")]
    assert {x for x in got if x[1] == 4} == {(d, 4) for d in long_doc}
    assert decontamination.leaks(empty, bench).count() == 0
    assert decontamination.leaks(awkward, bench.limit(0)).count() == 0
    assert decontamination.clean(awkward, bench).count() == awkward.count() - len(long_doc)


# language models


def test_losses_equal_a_plain_model(spark, documents):
    tokenizer, boundary = library(), 49_408
    texts = [*list(documents.items())[:60], (9_000, None), (9_001, " "), (9_002, "the the")]
    marked = [d for d, _ in texts[::3]]
    seqs = {}
    for d, t in texts:
        if ids := tokenizer.encode(t or "", add_special_tokens=False).ids:
            line = [boundary, *ids, boundary]
            seqs[d] = list(zip(line, line[1:], strict=False))
    def trained(own):
        pairs = Counter(p for d in own for p in seqs[d])
        unigram, total = Counter(), Counter()
        for (u, v), n in pairs.items():
            unigram[v] += n
            total[u] += n
        return pairs, unigram, total

    def loss(model, u, v):
        pairs, unigram, total = model
        p = (unigram[v] + lm_scores.SMOOTHING) / (sum(unigram.values()) + lm_scores.SMOOTHING * (boundary + 1))
        return -math.log((pairs[u, v] + lm_scores.PRIOR * p) / (total[u] + lm_scores.PRIOR))

    df = spark.createDataFrame(texts, "doc_id long, text string")
    ids = spark.createDataFrame([(d,) for d in [*marked, marked[0], None]], "doc_id long")
    results = []
    for held, limit in ((1_000_000, 1_000), (3_000, 0), (0, 1_000)):
        got = {r.doc_id: r for r in lm_scores.score(df, ids, WORD, boundary, held_bigrams=held, broadcast_ids=limit).collect()}
        assert len(got) == len(texts)
        results.append(got)
    for d in got:
        if d not in seqs:
            assert all(r[d].n_tokens == 0 and r[d].score is None for r in results)
            continue
        # models trained afresh without the document
        models = [trained([x for x in seqs if x != d and (x in marked) == own]) for own in (True, False)]
        t, b = (sum(loss(m, u, v) for u, v in seqs[d]) / len(seqs[d]) for m in models)
        for r in results:
            assert r[d].n_tokens == len(seqs[d]) - 1
            assert (r[d].target_loss, r[d].background_loss, r[d].score) == pytest.approx((t, b, t - b), abs=1e-9)


def test_probabilities_add_up():
    """Over all tokens after a context, with a document left out."""
    rng, size = np.random.default_rng(14), 30
    table = rng.integers(0, 9, (2, size, size)).astype(float)
    of = lm_scores.Base(table.sum(axis=1), table.sum(axis=2))
    for m, marked in ((0, True), (1, False), (0, False)):
        u = 4
        code = u * size + np.arange(size)
        p = lm_scores.parts(of, np.zeros(size, np.int64), code, np.array([marked]))
        held = np.maximum(table[m, u], 1)  # what a document holds is in the counts of its model
        of.total[m, u] += (held - table[m, u]).sum()
        p = lm_scores.parts(of, np.zeros(size, np.int64), code, np.array([marked]))
        assert ((held + p.more[m]) / p.whole[m]).sum() == pytest.approx(1)
        of.total[m, u] -= (held - table[m, u]).sum()


def test_losses_of_awkward_rows(spark, awkward, empty):
    got = lm_scores.score(awkward, awkward.limit(0), WORD, 49_408)
    assert got.count() == awkward.count()
    assert {round(r.target_loss, 3) for r in got.collect() if r.n_tokens} == {round(math.log(49_409), 3)}
    assert lm_scores.score(empty, awkward, WORD, 49_408).count() == 0


# lines


def brute_lines(rows, percent, least, keep_pages=False):
    pages, seen = Counter(), Counter()
    for _, t, s in rows:
        if s is not None:
            pages[s] += 1
            for x in {x.strip(" ") for x in (t or "").split("\n")} - {""} if t is not None else ():
                seen[s, x] += 1
    out = []
    for d, t, s in rows:
        if t is None:
            out.append((d, None, 0, 0))
            continue
        lines = t.split("\n")
        kept = [x for x in lines if not x.strip(" ") or not (seen[s, x.strip(" ")] >= least and seen[s, x.strip(" ")] * 100 > percent * pages[s])] if s is not None else lines
        if keep_pages and not any(x.strip(" ") for x in kept):
            kept = lines
        out.append((d, "\n".join(kept) if len(kept) < len(lines) else t, len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast, least, keep", [(0, 5, True), (100_000, 2, False), (100_000, 5, True)])
def test_boilerplate(spark, documents, broadcast, least, keep):
    rng = random.Random(10)
    rows = []
    for d, t in list(documents.items())[:80]:
        lines = [*t.split("\n"), *(["menu"] if rng.random() < 0.5 else []), *([" footer  "] * rng.randrange(3)), *(["rare"] if d % 20 == 0 else [])]
        rng.shuffle(lines)
        rows.append((d, "\n".join(lines), rng.choice(["a", "a", "b", None])))
    rows += [(900, "menu", "a"), (901, "menu\n \nfooter", "a"), (902, None, "a"), (903, "", "b"), (904, "x\n", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_dedup.drop_boilerplate(df, percent=20, min_pages=least, broadcast_lines=broadcast, keep_pages=keep)
    want = brute_lines(rows, 20, least, keep)
    assert rows_of(got, "doc_id", "text", "n_lines", "n_dropped") == want
    assert sum(x[3] for x in want) > 30


def test_boilerplate_of_awkward_rows(spark, awkward, empty):
    got = line_dedup.drop_boilerplate(awkward, min_pages=2)
    assert got.count() == awkward.count() and sorted(got.columns) == sorted({*awkward.columns, "n_lines", "n_dropped"})
    assert line_dedup.drop_boilerplate(empty).count() == 0


# the rest on an empty table


def test_empty_tables(empty):
    assert token_counts.token_counts(empty, PIECE).count() == 0
    assert bpe_codec.decode(bpe_codec.encode(empty, WORD), WORD, digests=True).count() == 0
    assert media.features(media.store(empty)).count() == 0
