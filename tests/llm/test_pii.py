import hashlib
import re

from pyspark.sql import functions as F

from tests.llm import samples
from veriflate.llm import pii as M

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, kind, m.end()))
    return ",".join(f"{kind}:{a}:{e}" for a, _, kind, e in sorted(out))


def test_base_spans(spark):
    rng, letters = samples.random.Random(3), "0123456789 -.+()@abÀ😀%_"
    pairs = samples.odd() + [(20, "a@b.c_d@e.f@g.h.i"), (21, "1.2.3.4.5.6.7.8"), (22, "4" * 60000), (23, "1 " * 60000), (24, "a" * 60000 + "@"), (25, "1." * 30000), (26, "😀 a@b.co 4111 1111 1111 1111 é +1 (743) 555-3824")]
    pairs += [(100 + i, "".join(rng.choice(letters[:12] if rng.random() < 0.5 else letters) for _ in range(rng.randrange(5, 200)))) for i in range(1500)]
    found = M.detect(samples.frame(spark, pairs)).select("doc_id", M._joined(F.col("base")).alias("b")).collect()
    assert len(found) == len(pairs)
    text = dict(pairs)
    assert [r for r in found if r.doc_id is not None and r.b != brute(text[r.doc_id])] == []


def test_method_adds_and_keeps(spark):
    clean = [(i, f"plain words number {i} and nothing else 12") for i in range(50)]
    keys = [(100 + i, f'token = "{hashlib.sha1(str(i).encode()).hexdigest()}" then text') for i in range(20)]
    mails = [(200 + i, f"write to user{i}@mail.example.com today") for i in range(5)]
    df = samples.frame(spark, clean + keys + mails)
    added = {r.doc_id: r.added for r in M.detect(df).collect()}
    assert all(len(added[i]) == 1 and added[i][0].kind == "secret" for i, _ in keys)
    assert not any(added[i] for i, _ in clean + mails)
    red = {r.doc_id: r for r in M.redacted(df).collect()}
    assert red[200].text == "write to <email> today" and red[100].text == 'token = "<secret>" then text' and red[0].text == clean[0][1]
    assert M.redacted(df).columns == df.columns


def test_null_and_empty(spark):
    df = samples.frame(spark, [(1, None), (2, "")])
    assert {r.doc_id: r.text for r in M.redacted(df).collect()} == {1: None, 2: ""}
    assert M.detect(samples.frame(spark, [])).count() == 0


def test_plan_has_no_python(spark):
    plan = M.detect(samples.frame(spark, [(1, "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_and_padded_secrets_are_candidates(spark):
    long, padded = "aB3/" * 75, "Zm9vYmFyYmF6cXV4MTIzNDU2Nzg5MA=="
    df = spark.createDataFrame([(f"key {long} end token {padded}.",)], "t string")
    assert [r.value for r in df.select(M.matches(df.t, M.SECRET, "secret").alias("m")).first().m] == [long, padded]
