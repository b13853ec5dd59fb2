import hashlib
import random
import re
import time
from dataclasses import replace

from eventide.llm import personal_data as pd
from tests.llm.helpers import awkward, empty


def brute(text):
    """The base rules with the plain patterns over characters."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        odd, even = d[::-1][::2], d[::-1][1::2]
        if 14 <= len(d) <= 19 and (sum(odd) + sum(sum(divmod(2 * x, 10)) for x in even)) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(out))


def texts():
    rnd = random.Random(5)
    pieces = ["@", ".", "a", "b-c", "_", "x@y.z", "a@b.c@d.e", "1.2.3.4", ".5.6.7.8", "256", "007.0000255.1.2", " ", "-", "+", "4111 1111 1111 1111", "79927398713",
              "4532015112830366", "0", "9", "+1 (523) 555-1055", "(", ")", "é", "日本", "\n", "\x00", "%", "token = ", "49-30", "+4", "5105105105105100 "]
    yield from ("".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 14))) for _ in range(4000))
    yield from ("".join(rnd.choice("01+-. (@a") for _ in range(rnd.randint(0, 40))) for _ in range(4000))


def base_of(text):
    raw = text.encode()
    return ",".join(f"{k}:{len(raw[:s].decode())}:{len(raw[:e].decode())}" for k, s, e, _, base in pd.finds(raw) if base)


def test_base_finds_equal_the_plain_patterns():
    some = 0
    for text in texts():
        want = brute(text)
        some += bool(want)
        assert base_of(text) == want, text
    assert some > 1000


def test_query_rows_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kinds = set()
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = pd.digest(pd.personal_data(docs)).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        base = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(base.count(k + ":") for k in pd.BASE_KINDS)
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
        kinds |= {s.split(":")[0] for s in r.spans.split(",")}
    assert {*pd.BASE_KINDS, "secret"} <= kinds


def found(text):
    return [(k, text.encode()[s:e].decode()) for k, s, e, _, base in pd.finds(text.encode()) if not base]


def test_checksums_confirm_and_context_decides():
    assert found("IBAN DE89 3704 0044 0532 0130 00 AND MORE") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert found("DE88 3704 0044 0532 0130 00") == [] == found("GB82 WEST 1234 5698 7654")
    assert found("his ssn 123-45-6789") == [("us_ssn", "123-45-6789")] and found("666-45-6789 900-45-6789") == []
    assert found("routing 021000021") == [("us_routing", "021000021")] and found("number 021000021") == [] == found("routing 021000022")
    assert found("NHS 943 476 5919") == [("nhs", "943 476 5919")] and found("943 476 5919") == [] == found("NHS 943 476 5918")
    assert found("DNI 12345678Z") == [("spanish_id", "12345678Z")] and found("12345678A") == []
    assert found("nir 1 85 05 78 006 084 91") == [("french_id", "1 85 05 78 006 084 91")] and found("1 85 05 78 006 084 92") == []
    assert found("steuer 86095742719") == [("german_tax_id", "86095742719")] and found("steuer 86095742718") == []
    assert found("2001:4860:4860::8888") == [("ipv6", "2001:4860:4860::8888")] and found("12:30:45 and 1:2:3") == []
    assert found("btc 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa") == [("bitcoin", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa")] and found("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb") == []
    assert found("born 1990-02-28") == [("birth_date", "1990-02-28")] and found("born 1990-02-30") == [] == found("on 1990-02-28")
    assert found('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"') == [("secret", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff")]
    assert found("hash 24be64439e3e49cf46b2d7c90f3602a3d0b907ff") == [] == found("token aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1")
    near, far = (pd.finds(f"{word} 8.8.8.8".encode())[0] for word in ("server", "river"))
    assert near[3] > far[3] and near[:3] == (far[0], far[1] + 1, far[2] + 1)


def samples():
    """Texts with finds of every kind, and random ones of the letters that the rules' patterns are made of."""
    yield from texts()
    yield from (
        "IBAN DE89 3704 0044 0532 0130 00", "his ssn 123-45-6789", "routing 021000021", "NHS 943 476 5919", "nhs 9434765919", "DNI 12345678Z", "nie X-1234567-L",
        "nir 1 85 05 78 006 084 91", "nir 185057800608491", "steuer 86095742719", "2001:4860:4860::8888", "ace:ace::cafe:beef", "mac aa:bb:cc:dd:ee:ff", "aa-bb-cc-dd-ee-ff",
        "btc 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "born 1990-02-28", "born 28.2.1990", "token 24be64439e3e49cf46b2d7c90f3602a3d0b907ff",
    )
    rnd = random.Random(9)
    parts = ["1", "9", "21", "1990", "000", "-", ":", ".", "/", " ", "a", "Z", "X", "ff", "born ", "nhs ", "token ", "routing ", "steuer "]
    yield from ("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(6000))


def test_pieces_skip_no_find_and_most_rules(monkeypatch):
    """Rules that are skipped for a text without one of their pieces have no find there; a text without digits or marks is read by none."""
    kinds = set()
    skipping = [pd.finds(t.encode()) for t in samples()]
    for name in ("BASE_RULES", "MORE_RULES"):
        monkeypatch.setattr(pd, name, tuple(replace(rule, pieces=(b"",)) for rule in getattr(pd, name)))
    for text, got in zip(samples(), skipping, strict=True):
        assert got == pd.finds(text.encode()), text
        kinds |= {f[0] for f in got}
    assert kinds == set(pd._RANK)
    monkeypatch.undo()

    class Unread:
        def finditer(self, raw):
            raise AssertionError(raw)

    for name in ("BASE_RULES", "MORE_RULES"):
        monkeypatch.setattr(pd, name, tuple(replace(rule, pattern=Unread()) for rule in getattr(pd, name)))
    assert pd.finds("plain words, born of a bank; account and token of nobody".encode()) == []


def test_finds_beside_base_finds_do_not_overlap_them():
    for text in ("secret 4111111111111111 token", "token aaaa1111bbbb2222cccc3333@mail.example", "routing +021000021000"):
        spans = sorted((s, e) for _, s, e, _, _ in pd.finds(text.encode()))
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)), text


def test_time_is_linear_in_very_long_texts():
    for piece in ("a", "1", "1.", "a@", "+1", "@a.", "1 ", "A1", "ab:", "f:", "token "):
        start = time.time()
        pd.finds((piece * (1_000_000 // len(piece))).encode())
        assert time.time() - start < 8, piece


def test_awkward_rows(spark):
    df = awkward(spark)
    got = pd.digest(pd.personal_data(df)).collect()
    assert len(got) == df.count() and pd.digest(pd.personal_data(empty(spark))).count() == 0
    assert {r.base_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()} and {r.spans for r in got} == {""}
