import datetime
import hashlib
import random

from pyspark.sql import functions as F

from llm_data import docs, empty
from shiftscope.llm import pii

KEY = "a key of the tests"


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def mod97(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def run(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [(r.text, [tuple(h) for h in r.pii_hits]) for r in pii.with_pseudonyms(d, KEY).orderBy("doc_id").collect()]


def test_formats_stay_valid_and_values_link(spark):
    texts = ["card 4785380592391139 end", "again 4785-3805-9239-1139, 4785380592391139", "iban GB82WEST12345698765432 and DE89 3704 0044 0532 0130 00",
             "ssn 123-45-6789", "ip 10.20.30.40.", "born 1980-02-29 or 31.12.1999", "call +1 (743) 555-3824!", "to hein.19@mail5.example.com###"]
    got = run(spark, texts)
    a, b = got[0][1][0][1], [h[1] for h in got[1][1]]
    assert luhn(a) and a != "4785380592391139" and b[1] == a and b[0].replace("-", "") == a and b[0][4] == "-"
    assert [k for k, _ in got[2][1]] == ["iban", "iban"] and all(mod97(v) for _, v in got[2][1])
    assert got[2][1][1][1][4] == " "
    for (new, hits), old in zip(got, texts):
        assert hits and new != old
        for _, v in hits:
            assert v in new and v not in old
    assert got[7][0].endswith(".com###") and got[7][0].startswith("to ")


def test_invalid_values_and_clean_text_stay(spark):
    texts = ["4785380592391138 666-12-1234 000-11-2222 999.1.1.1 1.2.3.4.5 30/02/2001 GB82WEST12345698765433", "plain text 12 at 13:45, 50% of 1000",
             "a" + "4785380592391139", "", None]
    got = run(spark, texts)
    assert [g[0] for g in got] == texts and not any(g[1] for g in got)


def test_network_is_a_permutation(spark):
    d = spark.range(0, 1500).selectExpr("cast(id div 100 as int) a", "cast(id % 100 as int) b")
    items = F.array(pii._item(F.lit(0), F.col("a"), 15), pii._item(F.lit(0), F.col("b"), 100))
    got = {tuple(r[0]) for r in d.select(pii.permute(items, "t", KEY)).collect()}
    assert len(got) == 1500 and all(0 <= x < 15 and 0 <= y < 100 for x, y in got)
    other = {tuple(r[0]) for r in d.filter("a = 0 and b < 5").select(pii.permute(items, "t", key="other")).collect()}
    assert other != {tuple(r[0]) for r in d.filter("a = 0 and b < 5").select(pii.permute(items, "t", KEY)).collect()}


def test_odd_rows_and_empty(spark):
    d = docs(spark)
    out = pii.with_pseudonyms(d, KEY)
    assert out.columns == [*d.columns, "pii_hits"]
    assert sorted((r.text or "") for r in out.collect()) == sorted((r.text or "") for r in d.collect())
    assert pii.op4_pii(empty(spark)).count() == 0
    many = run(spark, [" ".join(f"10.0.{i // 250}.{i % 250}" for i in range(2000))])[0]
    assert len(many[1]) == 2000 and len({v for _, v in many[1]}) == 2000


def test_no_python_in_the_plan(spark):
    plan = pii.op4_pii(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_spaced_iban_ends_with_its_countrys_length(spark):
    be, no, de = "BE68 5390 0754 7034", "NO93 8601 1117 947", "DE89 3704 0044 0532 0130 00"
    tails = [" BIC KREDBEBB", " 2024", " 4785 3805 9239 1139", ", end", ""]
    got = run(spark, [v + t for v in (be, no, de) for t in tails])
    for i, v in enumerate((be, no, de)):
        mine = got[i * len(tails):(i + 1) * len(tails)]
        assert len({h[0] for _, h in mine}) == 1 and mine[0][1][0][0] == "iban"
        new = mine[0][1][0][1]
        assert mod97(new) and new != v and len(new) == len(v)
        assert [g[0] for g in mine[:2] + mine[3:]] == [new + t for t in tails[:2] + tails[3:]]
        assert [k for k, _ in mine[2][1]] == ["iban", "card"]


def test_addresses_begin_after_signs(spark):
    plain = run(spark, ["john@example.com"])[0][0]
    texts = ["_john@example.com_", "-john@example.com", "...john@example.com", "%john@example.com", "+john@example.com", "a@b.org-john@example.com"]
    for old, (new, hits) in zip(texts, run(spark, texts)):
        assert hits[-1] == ("email", plain) and "john@example.com" not in new
        assert new.replace(plain, "john@example.com") == old or old.startswith("a@")


def test_iso_date_before_a_time(spark):
    got = run(spark, ["1980-05-17", "1980-05-17T00:00:00Z", "on 1980-05-17T0930, then", "1980-05-17Total 1980-05-171", "17.05.1980T00:00"])
    new = got[0][0]
    assert new != "1980-05-17" and [g[0] for g in got[1:3]] == [new + "T00:00:00Z", f"on {new}T0930, then"]
    assert [g[0] for g in got[3:]] == ["1980-05-17Total 1980-05-171", "17.05.1980T00:00"]


def feistel(symbols, tweak, key, rounds=8):
    """The network on a list of (base, value, modulus), symbol by symbol."""
    v, n = [x for _, x, _ in symbols], len(symbols)
    for r in range(rounds):
        mine = [i for i in range(n) if (i < n // 2) == (r % 2 == 0)]
        other = ",".join(str(v[i]) for i in range(n) if i not in mine)
        for i in mine:
            h = hashlib.sha256("|".join(map(str, (key, tweak, n, r, other, i))).encode()).hexdigest()
            v[i] = (v[i] + int(h[:12], 16) % (1 << 30)) % symbols[i][2]
    return [b + x for (b, _, _), x in zip(symbols, v)]


def test_values_equal_a_plain_restatement(spark):
    rng = random.Random(5)
    ips = [[rng.randrange(256) for _ in range(4)] for _ in range(40)]
    ssns = [(rng.choice([1, 665, 667, 899, 123]), rng.randrange(1, 100), rng.randrange(1, 10000)) for _ in range(40)]
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(73050)) for _ in range(40)]
    cards = [f"{rng.randrange(10 ** 14, 10 ** 15)}" for _ in range(40)]
    cards = [c + next(x for x in "0123456789" if luhn(c + x)) for c in cards]
    mails = [f"{rng.choice(['ann', 'Bo.B', 'x9_'])}{rng.randrange(99)}@mail.example-{rng.randrange(9)}.org" for _ in range(40)]
    phones = [f"{rng.randrange(200, 1000)}-{rng.randrange(200, 1000)}-{rng.randrange(10000):04d}" for _ in range(40)]
    want = [".".join(map(str, feistel([(0, x, 256) for x in p], "ip", KEY))) for p in ips]
    for a, g, s in ssns:
        x = feistel([(0, a - 1 if a < 666 else a - 2, 898), (1, g - 1, 99), (1, s - 1, 9999)], "ssn", KEY)
        want.append(f"{x[0] + 1 if x[0] < 665 else x[0] + 2:03d}-{x[1]:02d}-{x[2]:04d}")
    for d in days:
        at = (d - datetime.date(1900, 1, 1)).days
        x = feistel([(0, at // 487, 150), (0, at % 487, 487)], "date", KEY)
        want.append((datetime.date(1900, 1, 1) + datetime.timedelta(x[0] * 487 + x[1])).isoformat())
    for c in cards:
        body = "".join(map(chr, feistel([(48, int(x), 10) for x in c[:-1]], "card", KEY)))
        want.append(next(body + x for x in "0123456789" if luhn(body + x)))
    for m in mails:
        head = m.removesuffix("org")
        sym = [(97, ord(c) - 97, 26) if "a" <= c <= "z" else (65, ord(c) - 65, 26) if "A" <= c <= "Z"
               else (48, ord(c) - 48, 10) if c.isdigit() else (ord(c), 0, 1) for c in head]
        want.append("".join(map(chr, feistel(sym, "email", KEY))) + "org")
    for p in phones:
        x = [int(c) for c in p if c.isdigit()]
        new = "".join(map(chr, feistel([(50, c - 2, 8) if i in (0, 3) else (48, c, 10) for i, c in enumerate(x)], "phone", KEY)))
        want.append(f"{new[:3]}-{new[3:6]}-{new[6:]}")
    values = [".".join(map(str, p)) for p in ips] + [f"{a:03d}-{g:02d}-{s:04d}" for a, g, s in ssns] + [
        d.isoformat() for d in days] + cards + mails + phones
    assert [g[0] for g in run(spark, values)] == want


def test_a_phone_stays_linked_with_and_without_its_country(spark):
    texts = ["+1 743-555-3824", "743-555-3824", "(743) 555-3824", "743.555.3824", "743 555 3824", "+17435553824", "+1 (743) 555-3824"]
    got = [g[0] for g in run(spark, texts)]
    assert all(g != t for g, t in zip(got, texts))
    assert len({"".join(c for c in g if c.isdigit())[-10:] for g in got}) == 1 and got[0].startswith("+1 ")


def test_dates_with_slashes_are_linked(spark):
    a, b = (g[0] for g in run(spark, ["1980/05/17", "1980-05-17"]))
    assert a.replace("/", "-") == b != "1980-05-17"


def test_the_key_decides_and_clashing_columns_are_replaced(spark):
    d = spark.createDataFrame([("10.1.2.3", "mine")], "text string, pii_hits string")
    one, two = (pii.with_pseudonyms(d, k).collect()[0] for k in ("a", "b"))
    assert one.text != two.text and one.pii_hits[0].kind == "ip"
