import re
from hashlib import sha256

from lexstrata.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def valid(kind, v):
    n = sum(c.isdigit() for c in v)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in v.split(".")), "card": 16 <= n <= 19 and luhn(v), "phone": 8 <= n <= 15}[kind]


TEXTS = [
    None, "", "mail a.b@c.de, x@y.z.w. and a@b.com_x@y.org or a@@b.c d@e f@g..h",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.0255 9.9.9", "4111 1111 1111 1111 and 4111-1111-1111-1112, 41111111111111111111 6011000990139424",
    "+1 (743) 555-3824 +12 +1 2 +49 (0) 30 1234567890123 +44 20.7946.0958-", "é 4111111111111111 日本 a@b.co 🙂 10.0.0.1",
    "x" * 30000, "1" * 30000, "1.1." * 6000, "a@b" + ".c" * 9000, "4 " * 9000, "a@b.com " * 300, "+" + "1 " * 4000,
    "IBAN DE89 3704 0044 0532 0130 00 and DE89370400440532013001", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" 24be64439e3e49cf46b2d7c90f3602a3d0b907ff',
]


def test_base_spans_equal_plain_regular_expressions(documents):
    rows = {r.doc_id: r for r in pii.report(documents(TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        want = {k: [(m.start(), m.end()) for m in re.finditer(p, t or "") if valid(k, m.group(0))] for k, p in BASE.items()}
        text = ",".join(f"{k}:{a}:{b}" for k in BASE for a, b in want[k])
        r = rows[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(want[k]) for k in BASE), (i, (t or "")[:40])
        assert r.base_sha256 == sha256(text.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s.split(":")[0] in BASE] == [s for s in text.split(",") if s]


def test_scored_kinds(documents):
    rows = {r.doc_id: r for r in pii.report(documents(TEXTS[-2:])).collect()}
    assert rows[0].n_iban == 1 and "iban:5:32" in rows[0].spans
    assert rows[1].n_secret == 2 or "secret:9:49" in rows[1].spans


def test_redaction_and_odd_rows(documents):
    docs = documents([(1, "to a@b.co from 10.0.0.1 end"), (1, None), (None, "x"), (2, "+1 (743) 555-3824")]).withColumnRenamed("source", "email")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.n_chars or -1) for r in pii.redact(docs).collect())
    assert got == [(False, 1, "", -1), (False, 1, "to [EMAIL] from [IP] end", 24), (False, 2, "[PHONE]", 7), (True, 0, "x", 1)]
    assert pii.redact(docs).columns == docs.columns
    assert pii.report(docs.limit(0)).collect() == []


def test_accounts_of_every_length(documents):
    numbers = ["CH9300762011623852957", "HR1210010051863000160", "LV80BANK0000435195001", "UA213223130000026007233566001", "DE89370400440532013000", "CH93 0076 2011 6238 5295 7"]
    texts = ["to " + x + end for x in numbers for end in ("", ".", " and on")]
    texts += ["é 🙂 DE89 3704 0044 0532 0130 00 BIC COBADEFF", "DE89370400440532013000 CH9300762011623852957", "CH9300762011623852958", "xCH9300762011623852957", "CH9300762011623852957x", "AB12 " * 60, "A" * 30000, "AB12" + "X" * 30000]
    rows = {r.doc_id: r.spans for r in pii.report(documents(texts)).collect()}
    got = [[tuple(map(int, s.split(":")[1:])) for s in rows[i].split(",") if s.startswith("iban:")] for i in range(len(texts))]
    assert got[:18] == [[(3, 3 + len(x))] for x in numbers for _ in range(3)]
    assert got[18:23] == [[(4, 31)], [(0, 22), (23, 44)], [], [], []]
    assert got[24:] == [[], []]


def test_clashing_names_and_very_long_texts(documents):
    from lexstrata.llm import pii

    long = "x " * 200_000 + "mail a@b.org now " + "1.2.3.4 " * 300
    df = documents([long, "a@b.org", None])
    odd = df.withColumns({c: df["doc_id"] for c in ("email", "gaps_email", "values_ip", "__null", "__row", "__spans", "__text")})
    rows = {r.doc_id: r for r in pii.report(odd).collect()}
    assert (rows[0].n_email, rows[0].n_ip) == (1, 300) and rows[1].n_email == 1 and rows[2].n_email == 0
    kept = pii.redact(odd)
    assert kept.columns == odd.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert texts[1] == "[EMAIL]" and texts[2] is None and texts[0].count("[IP]") == 300


def test_many_matches_in_one_text(documents):
    import re

    from lexstrata.llm import pii

    text = "".join(f"{i % 256}.2.3.4 p{i}@x.org é " for i in range(3000))
    row = pii.report(documents([text])).first()
    want = [f"{k}:{m.start()}:{m.end()}" for k, p in (("email", r"p\d+@x\.org"), ("ip", r"\d+\.2\.3\.4")) for m in re.finditer(p, text)]
    assert row.spans == ",".join(want) and (row.n_email, row.n_ip) == (3000, 3000)
    assert pii.redact(documents([text])).first().text == "[IP] [EMAIL] é " * 3000
