"""Binary formats: published test vectors, round trips, damaged files."""

import pytest

from quire.formats import crypto, office, pdf


@pytest.mark.parametrize("size, want", [(16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (24, "dda97ca4864cdfe06eaf70a0ec0d7191"), (32, "8ea2b7ca516745bfeafc49904b496089")])
def test_aes_vectors(size, want):
    plain = bytes.fromhex("00112233445566778899aabbccddeeff")
    cipher = crypto.Aes(bytes(range(size)))
    assert cipher.encrypt_block(plain).hex() == want and cipher.decrypt_block(bytes.fromhex(want)) == plain


def test_rc4_vector():
    assert crypto.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"


@pytest.mark.parametrize("revision", [2, 3, 4])
def test_early_passwords(revision):
    e = crypto.Encryption(revision, 16, b"", b"", -44, b"id")
    e.owner = crypto.early_owner(b"own", b"usr", e)
    key = crypto.early_key(b"usr", e)
    e.user = crypto.early_user(key, e).ljust(32, b"\0")
    assert crypto.file_key(b"usr", e) == key == crypto.file_key(b"own", e)
    with pytest.raises(crypto.WrongPassword):
        crypto.file_key(b"other", e)


@pytest.mark.parametrize("revision", [5, 6])
def test_late_passwords(revision):
    import hashlib

    digest = crypto.hardened if revision == 6 else lambda p, salt, extra=b"": hashlib.sha256(p + salt + extra).digest()
    key, us, uk, os_, ok = bytes(range(32)), b"12345678", b"abcdefgh", b"87654321", b"hgfedcba"
    user = digest(b"usr", us) + us + uk
    owner = digest(b"own", os_, user) + os_ + ok
    e = crypto.Encryption(revision, 32, owner, user, -44, b"", crypto.cbc_encrypt(digest(b"own", ok, user), bytes(16), key, pad=False), crypto.cbc_encrypt(digest(b"usr", uk), bytes(16), key, pad=False))
    assert crypto.file_key(b"usr", e) == key == crypto.file_key(b"own", e)
    with pytest.raises(crypto.WrongPassword):
        crypto.file_key(b"other", e)


def test_pdf_round_trip():
    pages = [pdf.Page([pdf.Placed("Hello (world) \\ é", 72, 700), pdf.Placed("second", 72, 680, 14)], rotation=90), pdf.Page(width=300, height=400)]
    file = pdf.File(pdf.write(pages, {"Title": "T (x)", "Author": "Ä"}))
    assert [pdf.page_text(file, p) for p in file.pages()] == ["Hello (world) \\ é second", ""]
    assert file.info() == {"Title": "T (x)", "Author": "Ä"}
    assert file.items(file.pages()[0])[1] | {"width": 0} == {"text": "second", "x": 72, "y": 680, "size": 14, "width": 0}


def test_pdf_password():
    content = pdf.write([pdf.Page([pdf.Placed("secret", 1, 1)])], {"Title": "t"}, password="pw", owner="own")
    assert b"secret" not in content
    for password in ("pw", "own"):
        file = pdf.File(content, password)
        assert pdf.page_text(file, file.pages()[0]) == "secret" and file.info() == {"Title": "t"}
    with pytest.raises(pdf.Unreadable, match="password"):
        pdf.File(content)


def test_pdf_files_with_errors(spark):
    good = pdf.write([pdf.Page([pdf.Placed("x", 1, 1)])])
    files = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(good[:60])), ("c", None), ("d", bytearray(b""))], "path string, content binary")
    got = {r.path: r for r in pdf.read_files(files).collect()}
    assert got["a"].text == "x" and got["a"].error is None
    assert all(got[k].error and got[k].page == 0 for k in "bcd")


def test_workbook():
    content = office.write_workbook([("A & B", [(0, 0, "x<y", None, True, False), (1, 54, "", 1234.5, False, True)])])
    assert office.read_workbook(content) == [("A & B", 0, 0, "x<y", None), ("A & B", 1, 54, "1234.5", 1234.5)]
    assert office.write_workbook([("A & B", [(0, 0, "x<y", None, True, False), (1, 54, "", 1234.5, False, True)])]) == content


def test_document_and_presentation():
    blocks = [("heading", "T"), ("paragraph", "a\nb & c"), ("row", "1\t2"), ("row", "3\t4"), ("paragraph", "")]
    assert office.read_document(office.write_document(blocks)) == blocks
    slides = [[("title", "Hi"), ("", "a\nb")], [("body", "x")]]
    assert office.read_presentation(office.write_presentation(slides)) == [(1, 0, "title", "Hi"), (1, 1, "", "a\nb"), (2, 0, "body", "x")]


def test_names():
    assert [office.column_name(i) for i in (0, 25, 26, 54)] == ["A", "Z", "AA", "BC"]
    assert office.reference("BC12") == (11, 54) and office.reference("b2") is None
    assert office.resolved("ppt/slides", "../media/a.png") == "ppt/media/a.png" and office.resolved("x", "/y/z") == "y/z"


def test_office_files_with_errors(spark):
    good = office.write_document([("paragraph", "x")])
    files = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(good[:50])), ("c", None), ("d", bytearray(b"\xd0\xcf\x11\xe0" * 4))], "path string, content binary")
    got = {r.path: r for r in office.read_files(files, "docx").collect()}
    assert got["a"].text == "x" and all(got[k].error for k in "bcd")


def test_pdf_marks():
    drawn = [b"q 2 0 0 2 10 10 cm 0 0 1 RG 0.5 w 0 0 m 50 0 l S Q", b"1 0 0 rg 100 100 80 40 re f", b"0.5 g 10 300 200 1 re f", b"0 0 0 1 K 20 20 m 20 90 l S", b"5 5 m 9 30 l S"]
    file = pdf.File(pdf.write([pdf.Page(drawn=drawn)]))
    rules, fills = file.marks(file.pages()[0])
    assert rules == [(True, 10, 10, 110, 0.5, "0000FF"), (True, 300.5, 10, 210, 1, "808080"), (False, 20, 20, 90, 1.0, "000000")]
    assert fills == [(100, 100, 180, 140, "FF0000")]


def test_pdf_fields_and_images():
    body = b"""%PDF-1.7
1 0 obj << /Type /Catalog /Pages 2 0 R /AcroForm << /Fields [4 0 R 5 0 R 8 0 R] >> >> endobj
2 0 obj << /Type /Pages /Count 1 /Kids [3 0 R] >> endobj
3 0 obj << /Type /Page /Parent 2 0 R /Annots [6 0 R 4 0 R] /Resources << /XObject << /I 7 0 R >> >> >> endobj
4 0 obj << /T (pick) /FT /Ch /Ff 131072 /V (b) /Opt [(a) [(x) (b)]] >> endobj
5 0 obj << /T (who) /FT /Tx /Ff 3 /Kids [6 0 R] >> endobj
6 0 obj << /T (name) /Parent 5 0 R /V (Jane \\(J\\)) >> endobj
7 0 obj << /Type /XObject /Subtype /Image /Width 8 /Height 9 /Filter /DCTDecode /Length 0 >> stream
endstream endobj
8 0 obj << /T (sign) /FT /Sig >> endobj
trailer << /Root 1 0 R >>"""
    file = pdf.File(body)
    assert [(f["name"], f["kind"], f["value"], f["choices"], f["read_only"], f["required"], f["page"]) for f in file.fields()] == [("pick", "dropdown", "b", ["a", "b"], False, False, 1), ("who.name", "text", "Jane (J)", [], True, True, 1)]
    assert file.images(file.pages()[0]) == [("I", 8, 9, "DCTDecode")]
