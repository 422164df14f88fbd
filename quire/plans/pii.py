"""Queries over personal data, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import pii
from quire.sources.tables import dealt, table

#: Lines of a contact card: {k} stands for the customer's number in nine digits, {4} for the last four of them.
CARD = (
    "Contact: c{k}@example.org or +91 98765 4{4}", "j a n e {4} @ x . c o m", "SSN 123-45-{4}", "4111 1111 1111 {4}", "152.143.123.131",
    "see https://www.linkedin.com/in/c-{k} and github.com/c{k}", "born 31/12/1999 or 1999-12-31", "Name: Jane Doe; Phone: 555.987.{4}",
    "E-mail: c{k}@x.io", "Address: {4} Park Road, Pune 411001", "221B Baker Street, London", "Jane Doe | Pune | c{k}@x.io", "Plot {4}, Sector 21", "Dr. Ada Lovelace, PhD",
    "Senior Engineer", "amit kumar", "Name", "Jane Doe", "call + 9 1 9 8 7 6 5 4 {4} now", "see linkedin.com/in/c{k}", "Pune • c{k}@x.io • Pune", "Address", "Flat {4}, Hill View", "Mumbai, India", "Skills", "DOB - 01.02.2003", "987654{4}",
)


def _hits(rows: DataFrame, key: str) -> DataFrame:
    return pii.scan(rows, key).select(key, "line", "kind", "value", "start", "stop")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: a contact card of each customer, whose lines begin at another one from customer to customer."""
    key, turn = F.lpad(F.col("c_custkey").cast("string"), 9, "0"), (F.col("c_custkey") % len(CARD)).cast("int")
    lines = F.array(*map(F.lit, CARD))
    text = F.array_join(F.concat(F.slice(lines, turn + 1, len(CARD)), F.slice(lines, F.lit(1), turn)), "\n")
    return dealt(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(F.col("c_custkey").cast("long").alias("doc_id"), F.replace(F.replace(text, F.lit("{k}"), key), F.lit("{4}"), F.substring(key, -4, 4)).alias("text"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def pii_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    hits = lines.select("doc_id", F.col("line").cast("long").alias("line"), F.explode(pii.pattern_hits(F.col("t"))).alias("h"))
    return hits.select("doc_id", "line", pii.kind_of(F.col("h.kind")).alias("kind"), "h.value", F.col("h.start").cast("long").alias("start"))


def pii_in_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations")
    hits = talk.select("role", F.explode(F.split("text", "\n")).alias("t")).select("role", F.explode(pii.pattern_hits(F.col("t"))).alias("h"))
    return hits.groupBy("role", pii.kind_of(F.col("h.kind")).alias("kind")).agg(F.count("*").alias("n"))


def pii_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hits = docs.select("lang", "source", F.explode(F.split("text", "\n")).alias("t")).select("lang", "source", F.explode(pii.pattern_hits(F.col("t"))).alias("h"))
    return hits.groupBy("lang", "source", pii.kind_of(F.col("h.kind")).alias("kind")).agg(F.count("*").alias("n"))


def pii_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of every pattern in the lines of the cards."""
    lines = cards(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return lines.select("doc_id", "line", F.explode(pii.pattern_hits(F.col("t"))).alias("h")).select("doc_id", "line", "h.kind", "h.value", F.col("h.start").cast("long").alias("start"))


def pii_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule says of every line of the cards."""
    t = F.col("t")
    lines = cards(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return lines.select("doc_id", "line", pii.is_address(t).alias("address"), pii.continues_address(t).alias("continues"), pii.is_person(t).alias("person"), pii.is_solo_label(t).alias("solo"), pii.is_phone(t).alias("phone"), pii.is_card(t).alias("card"))


def pii_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in closed-up lines of documents and of cards."""
    rows = _documents(spark, sf_dir).withColumn("card", F.lit(False)).union(cards(spark, sf_dir).withColumn("card", F.lit(True)))
    rows = rows.select("card", F.col("doc_id").alias("id"), F.explode(F.split("text", "\n")).alias("t"))
    return rows.select("card", "id", F.explode(pii.collapsed_hits(F.col("t"))).alias("h")).select("card", "id", "h.kind", "h.value")


def _context(rows: DataFrame) -> DataFrame:
    hits = rows.select("doc_id", F.explode(pii.context_hits(F.split("text", "\n"))).alias("h"))
    return hits.select("doc_id", "h.line", pii.kind_of(F.col("h.kind")).alias("kind"), "h.value")


def _kinds(rows: DataFrame) -> DataFrame:
    return pii.kinds(rows).select("doc_id", F.array_join("kinds", ",").alias("kinds"))


def _masked(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", pii.masked(F.col("text")).alias("text"))


def pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(_documents(spark, sf_dir), "doc_id")


def pii_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(_documents(spark, sf_dir))


def pii_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinds(_documents(spark, sf_dir))


def pii_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(_documents(spark, sf_dir))


def pii_card_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(cards(spark, sf_dir), "doc_id")


def pii_card_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(cards(spark, sf_dir))


def pii_card_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinds(cards(spark, sf_dir))


def pii_card_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(cards(spark, sf_dir))


def pii_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.status(table(spark, sf_dir, "documents"))


def _sql(t: str) -> str:
    return t.replace("'", "''")


def _places(source: str, keys: str, column: str, pattern: str) -> str:
    """DuckDB: keys, value, start of every match of a pattern in a column."""
    before = "list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0)"
    return f"SELECT {keys}, unnest(m) AS value, CAST(unnest(list_transform(range(1, len(m) + 1), lambda i: {before})) AS BIGINT) AS start FROM (SELECT {keys}, regexp_extract_all({column}, '{_sql(pattern)}') AS m, string_split_regex({column}, '{_sql(pattern)}') AS b FROM {source}) WHERE len(m) > 0"


def _found(source: str, keys: str) -> str:
    """DuckDB: hits of every pattern over the column t of ``source``."""
    checks = {"phone": "BETWEEN 10 AND 15", "card": "BETWEEN 13 AND 19"}
    where = {kind: f"WHERE length(regexp_replace(value, '[^0-9]', '', 'g')) {c}" for kind, c in checks.items()}
    return " UNION ALL ".join(f"SELECT {keys}, '{kind}' AS kind, value, start FROM ({_places(source, keys, 't', p)}) {where.get(kind, '')}" for kind, p in pii.PATTERNS.items())


KIND = "CASE WHEN kind = 'profile-url' THEN 'profile' ELSE kind END"
DOC_LINES = "doc_lines AS (SELECT doc_id, lang, source, unnest(range(len(p))) AS line, unnest(p) AS t FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS p FROM documents))"
QUERIES = {f.__name__: f for f in (pii_patterns, pii_in_conversations, pii_by_source, pii_examples, pii_rules, pii_collapsed, pii_scan, pii_context, pii_kinds, pii_masked, pii_card_scan, pii_card_context, pii_card_kinds, pii_card_masked, pii_status)}
_names = ", ".join(f"'{n}'" for n in pii.NOT_A_NAME)


def _match(pattern: str, column: str = "x") -> str:
    return f"regexp_matches({column}, '{_sql(pattern)}')"


def _blank_free(also: str) -> str:
    return f"[{T.BLANKS}\\x{{200b}}{also}]"


#: What the rules ask of a line, as x with single spaces and tr with its ends trimmed.
_FLAGS = f"""n AS (SELECT *, regexp_replace(regexp_replace(t, '{T.BLANK}+', ' ', 'g'), '^ +| +$', '', 'g') AS x, regexp_replace(t, '^{T.BLANK}+|{T.BLANK}+$', '', 'g') AS tr FROM l),
f AS (SELECT *, length(regexp_replace(x, '[^0-9]', '', 'g')) AS d, {_match(pii.STREET)} AS street, {_match(pii.PIN)} AS pin, {_match('[0-9]')} AS digit, {_match(pii.COMMA_PLACE)} AS place, lower(x) IN ({_names}) AS heading, contains(x, '@') AS at_sign,
  regexp_replace(regexp_replace(x, '(?i)^(?:Dr|Mr|Mrs|Ms|Miss|Prof|Professor)\\.? +', ''), '(?i), *(?:PMP|MBA|PhD|CPA|Esq\\.?)$', '') AS bare FROM n)"""
_ADDRESS = f"""length(x) BETWEEN 8 AND 140 AND NOT heading AND NOT at_sign AND NOT {_match('(?i)^https?:')} AND NOT (d BETWEEN 10 AND 15 AND NOT street)
    AND (({_match('(?i)^(?:address|location|residence|current address|permanent address|home address)' + chr(92) + 'b')} AND length(x) > 12) OR (street AND (digit OR place)) OR (pin AND (street OR place OR digit)) OR (digit AND place AND {_match('[A-Za-z]{3,}')}))"""
_CONTINUES = f"length(x) BETWEEN 3 AND 100 AND NOT heading AND NOT {_match(pii.SECTION)} AND NOT at_sign AND (street OR pin OR {_match(', *[A-Za-z]')} OR {_match(pii.PLACES)})"
_CASED = "(regexp_matches(bare, '^[A-Z][a-z]+(?:[-''][A-Z][a-z]+)*(?: +[A-Z](?:\\.|[a-z]+(?:[-''][A-Z][a-z]+)*)?){1,3}$') OR regexp_matches(bare, '^[A-Z]{2,}(?: +[A-Z](?:\\.|[A-Z]{1,})?){1,3}$'))"
_UNCASED = "regexp_matches(bare, '^[A-Za-z][A-Za-z''-]*(?: +[A-Za-z][A-Za-z''-]*){1,3}$')"
_NAMED = f"length(x) BETWEEN 3 AND 70 AND NOT heading AND NOT {_match('[0-9@|/•·]')} AND NOT {_match('(?i)https?:')} AND NOT {_match(pii.JOBS, 'bare')}"
_label = _sql(pii.LABEL_VALUE)
#: Answers to labels and continued addresses, over lines l(doc_id, line, t).
_CONTEXT = f"""{_FLAGS},
h AS (SELECT *, {_ADDRESS} AS address, {_CONTINUES} AS goes_on, {_NAMED} AND {_CASED} AS cased, {_NAMED} AND {_UNCASED} AS uncased, {_match(pii.SOLO_LABEL)} AS solo, tr <> '' AND lower(tr) NOT IN ({_names}) AND NOT {_match(pii.SECTION, 'tr')} AS usable FROM f),
labels AS (SELECT doc_id, line, 'label-' || lower(regexp_extract(value, '{_label}', 1)) AS kind, regexp_extract(value, '{_label}', 2) AS raw, start + length(value) AS stop FROM ({_places('l', 'doc_id, line', 't', pii.LABEL_VALUE)})),
lh AS (SELECT doc_id, line, kind, regexp_replace(raw, '^{T.BLANK}+|{T.BLANK}+$', '', 'g') AS value, stop - length(raw) AS start FROM labels),
al AS (SELECT DISTINCT doc_id, line FROM lh WHERE value <> '' AND regexp_matches(kind, 'address|location|reside')),
c0 AS (SELECT h.*, al.line IS NOT NULL AS labelled, lower(regexp_replace(tr, ':$', '')) AS label, {", ".join(f"lead(tr, {k}) OVER w AS tr{k}, coalesce(lead(usable, {k}) OVER w, false) AS usable{k}, coalesce(lead(solo, {k}) OVER w, true) AS solo{k}, coalesce(lead(address OR goes_on, {k}) OVER w, false) AS more{k}" for k in (1, 2))}
  FROM h LEFT JOIN al ON al.doc_id = h.doc_id AND al.line = h.line WINDOW w AS (PARTITION BY h.doc_id ORDER BY h.line)),
c1 AS (SELECT *, solo AND usable1 AND NOT solo1 AS takes, regexp_matches(label, 'address|location|reside') AS about FROM c0),
c2 AS (SELECT *, takes AND about AND usable2 AND NOT solo2 AS takes2, (address OR (takes AND about) OR labelled) AND usable1 AND more1 AS goes FROM c1),
answers AS (SELECT doc_id, line + 1 AS line, 'label-' || label AS kind, tr1 AS value FROM c2 WHERE takes UNION ALL SELECT doc_id, line + 2, 'label-' || label, tr2 FROM c2 WHERE takes2
  UNION ALL SELECT doc_id, line + 1, 'address', tr1 FROM c2 WHERE goes UNION ALL SELECT doc_id, line + 2, 'address', tr2 FROM c2 WHERE goes AND usable2 AND more2)"""
_REST = "substring(kind, 7)"
_REPORTED = f"""CASE WHEN kind = 'profile-url' THEN 'profile' WHEN NOT starts_with(kind, 'label-') THEN string_split(kind, '-')[1] WHEN contains({_REST}, 'name') THEN 'name' WHEN regexp_matches({_REST}, 'phone|mobile|tel|cell') THEN 'phone'
  WHEN contains({_REST}, 'email') THEN 'email' WHEN regexp_matches({_REST}, 'address|location|reside') THEN 'address' WHEN regexp_matches({_REST}, 'dob|birth') THEN 'dob' ELSE 'label' END"""


def _closed(kind: str, also: str, pattern: str) -> str:
    """DuckDB: hits of the closed-up line at their places in the open one."""
    free = _blank_free(also)
    shut = f"SELECT doc_id, line, t, list_filter(range(1, length(t) + 1), lambda i: NOT regexp_matches(t[i], '^{free}$')) AS open, regexp_replace(t, '{free}', '', 'g') AS m0 FROM l WHERE regexp_matches(t, '@|(?:[0-9][^0-9]*){{10}}')"
    return f"SELECT doc_id, line, '{kind}' AS kind, substring(t, open[start + 1], open[start + length(value)] - open[start + 1] + 1) AS value, open[start + 1] - 1 AS start, open[start + length(value)] AS stop FROM ({_places(f'({shut})', 'doc_id, line, t, open', 'm0', pattern)})" + (" WHERE length(regexp_replace(value, '[^0-9]', '', 'g')) BETWEEN 10 AND 15" if kind == "phone" else "")


_DOCS = "docs AS (SELECT doc_id, text FROM documents)"
_CARD_LINES = "[" + ", ".join(f"'{_sql(t)}'" for t in CARD) + "]"
#: The same columns, of the cards.
_CARDS = f"""docs AS (SELECT CAST(c_custkey AS BIGINT) AS doc_id, replace(replace(array_to_string(list_concat(c[r + 1 : {len(CARD)}], c[1 : r]), chr(10)), '{{k}}', k), '{{4}}', right(k, 4)) AS text
  FROM (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS k, CAST(c_custkey % {len(CARD)} AS INTEGER) AS r, {_CARD_LINES} AS c FROM customer))"""
_LINES = f"""{_DOCS},
l AS (SELECT doc_id, unnest(range(len(p))) AS line, unnest(p) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM docs))"""
#: Every hit of every detector.
_ALL = f"""{_LINES}, {_CONTEXT},
parts AS (SELECT doc_id, line, t, tr, list_filter(string_split_regex(tr, '{T.BLANK}*[|/•·]{T.BLANK}*'), lambda p: NOT contains(p, '@') AND NOT length(regexp_replace(p, '[^0-9]', '', 'g')) BETWEEN 10 AND 15 AND regexp_matches(p, '^[A-Za-z][A-Za-z .''-]{{2,40}}$') AND lower(p) NOT IN ({_names})) AS p
  FROM h WHERE regexp_matches(tr, '[|/•·]') AND (contains(tr, '@') OR regexp_matches(tr, '[0-9]{{8,}}'))),
placed AS (SELECT doc_id, line, t, tr, p, 0 AS k, 0 AS stop FROM parts UNION ALL SELECT doc_id, line, t, tr, p, k + 1, stop + instr(substring(tr, stop + 1), p[k + 1]) - 1 + length(p[k + 1]) FROM placed WHERE k < len(p)),
first AS (SELECT doc_id, min(line) AS line FROM h WHERE tr <> '' GROUP BY doc_id),
raw AS (SELECT doc_id, line, kind, value, start, start + length(value) AS stop FROM ({_found('l', 'doc_id, line')})
  UNION ALL {_closed('email', chr(92) + 'x{ad}', pii.COLLAPSED_EMAIL)} UNION ALL {_closed('phone', '', pii.COLLAPSED_PHONE)}
  UNION ALL SELECT doc_id, line, kind, value, start, start + length(value) FROM lh WHERE value <> ''
  UNION ALL SELECT doc_id, line, 'address', t, 0, length(t) FROM h WHERE address
  UNION ALL SELECT doc_id, line, 'address', p[k], instr(t, tr) - 1 + stop - length(p[k]), instr(t, tr) - 1 + stop FROM placed WHERE k > 0
  UNION ALL SELECT a.doc_id, a.line, a.kind, l.t, 0, length(l.t) FROM answers a JOIN l ON l.doc_id = a.doc_id AND l.line = a.line
  UNION ALL SELECT h.doc_id, h.line, 'name', t, 0, length(t) FROM h LEFT JOIN first ON first.doc_id = h.doc_id AND first.line = h.line WHERE h.line < {pii.TOP_LINES} AND (cased OR (uncased AND first.line IS NOT NULL))),
hits AS (SELECT DISTINCT doc_id, CAST(line AS INTEGER) AS line, kind, value, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop FROM raw)"""
SQL = {
    "pii_patterns": f"WITH {DOC_LINES} SELECT doc_id, line, {KIND} AS kind, value, CAST(start AS BIGINT) AS start FROM ({_found('doc_lines', 'doc_id, line')})",
    "pii_in_conversations": f"WITH l AS (SELECT role, unnest(string_split(text, chr(10))) AS t FROM conversations) SELECT role, {KIND} AS kind, count(*) AS n FROM ({_found('l', 'role')}) GROUP BY ALL",
    "pii_by_source": f"WITH {DOC_LINES} SELECT lang, source, {KIND} AS kind, count(*) AS n FROM ({_found('doc_lines', 'lang, source')}) GROUP BY ALL",
    "pii_examples": f"WITH {_LINES.replace(_DOCS, _CARDS)} SELECT doc_id, CAST(line AS INTEGER) AS line, kind, value, CAST(start AS BIGINT) AS start FROM ({_found('l', 'doc_id, line')})",
    "pii_rules": f"WITH {_LINES.replace(_DOCS, _CARDS)}, {_FLAGS} SELECT doc_id, CAST(line AS INTEGER) AS line, {_ADDRESS} AS address, {_CONTINUES} AS continues, {_NAMED} AND ({_CASED} OR {_UNCASED}) AS person, {_match(pii.SOLO_LABEL)} AS solo, d BETWEEN 10 AND 15 AS phone, d BETWEEN 13 AND 19 AS card FROM f",
    "pii_collapsed": f"""WITH {_CARDS},
l AS (SELECT false AS card, doc_id AS id, unnest(string_split(text, chr(10))) AS t FROM documents UNION ALL SELECT true, doc_id, unnest(string_split(text, chr(10))) FROM docs),
c AS (SELECT id, regexp_replace(t, '[{T.BLANKS}\\x{{200b}}\\x{{ad}}]', '', 'g') AS m, regexp_replace(t, '[{T.BLANKS}\\x{{200b}}]', '', 'g') AS p, card FROM l),
f AS (SELECT card, id, 'email' AS kind, unnest(regexp_extract_all(m, '{_sql(pii.COLLAPSED_EMAIL)}')) AS value FROM c UNION ALL SELECT card, id, 'phone', unnest(regexp_extract_all(p, '{_sql(pii.COLLAPSED_PHONE)}')) FROM c)
SELECT card, CAST(id AS BIGINT) AS id, kind, value FROM f WHERE kind = 'email' OR length(regexp_replace(value, '[^0-9]', '', 'g')) BETWEEN 10 AND 15""",
    "pii_context": f"WITH {_LINES}, {_CONTEXT} SELECT doc_id, CAST(line AS INTEGER) AS line, {_REPORTED} AS kind, value FROM answers",
    "pii_scan": f"WITH RECURSIVE {_ALL} SELECT doc_id, line, {_REPORTED} AS kind, value, start, stop FROM hits",
    "pii_kinds": f"WITH RECURSIVE {_ALL}, k AS (SELECT doc_id, {_REPORTED} AS kind, min({{'line': line, 'start': start}}) AS spot FROM hits GROUP BY ALL) SELECT doc_id, string_agg(kind, ',' ORDER BY spot, kind) AS kinds FROM k GROUP BY doc_id",
    "pii_masked": f"""WITH RECURSIVE {_ALL}, g AS (SELECT doc_id, line, list({{'start': start, 'stop': stop}}) AS places FROM hits GROUP BY ALL),
m AS (SELECT l.doc_id, l.line, CASE WHEN places IS NULL THEN t ELSE array_to_string(list_transform(range(1, length(t) + 1), lambda i: CASE WHEN len(list_filter(places, lambda h: h.start < i AND i <= h.stop)) > 0 THEN '{pii.MASK}' ELSE t[i] END), '') END AS t FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.line = l.line),
j AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY line) AS text FROM m GROUP BY doc_id) SELECT docs.doc_id, j.text FROM docs LEFT JOIN j ON j.doc_id = docs.doc_id""",
    "pii_status": f"SELECT doc_id, CAST(length(regexp_replace(coalesce(text, ''), '{T.BLANK}', '', 'g')) AS INTEGER) AS visible, CASE WHEN length(regexp_replace(coalesce(text, ''), '{T.BLANK}', '', 'g')) < 8 THEN 'ocr' ELSE 'scan' END AS status FROM documents",
}
SQL |= {f"pii_card_{n}": SQL[f"pii_{n}"].replace(_DOCS, _CARDS) for n in ("scan", "context", "kinds", "masked")}
