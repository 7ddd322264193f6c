import datetime as dt
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from cairnlake.llm import mixing, pii


def fill(sizes, weights, cap):
    """Shares out the total by weight, again and again, until nothing is above its cap."""
    total, taken, rest = sum(sizes), {}, set(range(len(sizes)))
    while rest:
        left, w = total - sum(taken.values()), sum(weights[i] for i in rest)
        above = {i for i in rest if left * weights[i] / w > cap * sizes[i]}
        if not above:
            return taken | {i: left * weights[i] / w for i in rest}
        taken |= {i: cap * sizes[i] for i in above}
        rest -= above
    return taken


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_repeated_sharing(spark, seed):
    rng = random.Random(seed)
    names = [f"s{i:02d}" for i in range(12)] + [None]
    sizes = [rng.choice([0, 1, 5, 100, 10_000]) for _ in names]
    df = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 3)
    assert all(got[n] == pytest.approx(want[i], abs=1e-6) for i, n in enumerate(names))


def test_mixture(docs):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 30), "en", rng.choice(["a", "b", "c", "d", None])) for i in range(800)] + [(900, None, "en", "a"), (None, "x y", "en", "z"), (1, "x", "en", "a"), (1, "x", "en", "a")]
    df = docs(rows, extra=True)
    plan = mixing.mixture_plan(df)
    got = plan.collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mixture_plan(df).collect()))
    assert all(r.taken == r.size * r.copies and r.taken <= 3 * r.size for r in got)
    by_source = {}
    for r in got:
        by_source.setdefault((r.source_size, r.target), []).append(r.taken)
    assert sum(r[1] for r in by_source) == pytest.approx(sum(r.size for r in got))
    assert all(abs(sum(t) - target) <= 0.25 * target + 40 for (_, target), t in by_source.items())
    twice = mixing.mix(df.withColumn("copy", F.lit("own")))
    assert twice.columns == [*df.columns, "copy", "copy_"] and {r["copy"] for r in twice.select("copy").collect()} == {"own"}
    mixed = mixing.mix(df)
    assert mixed.columns == [*df.columns, "copy"]
    assert mixed.groupBy("doc_id").count().where("doc_id = 5").collect()[0]["count"] == next(r.copies for r in got if r.doc_id == 5) if next(r.copies for r in got if r.doc_id == 5) else True
    assert mixed.count() == sum(r.copies for r in got)
    assert mixing.mixture_plan(docs([])).count() == 0 and mixing.mix(docs([])).count() == 0


def test_mix_shuffles_no_text(docs):
    """Sources are broadcast by their count; beyond the bound the result is the same, and far more are an error."""
    rows = [(i, "w " * (i % 7), "en", f"s{i % 5}") for i in range(60)]
    df = docs(rows)
    plan = mixing.mix(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    want = sorted(map(str, mixing.mix(df).collect()))
    for name, value in (("BROADCAST_SOURCES", 2), ("MOST_SOURCES", 4)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(mixing, name, value)
            if name == "MOST_SOURCES":
                with pytest.raises(ValueError):
                    mixing.mix(df)
            else:
                assert sorted(map(str, mixing.mix(df).collect())) == want


def luhn(s):
    digits = [int(c) for c in reversed(re.sub(r"\D", "", s))]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


FINDS = {
    "n_card": ["4337166598464399", "4337-1665-9846-4399", "4337 1665 9846 4399"],
    "n_phone": ["+1 (456) 555-2186", "456-555-2186"],
    "n_ip": ["17.252.227.210", "0.0.0.0"],
    "n_email": ["pfps.64@mail3.example.com", "A_b+1@x.org"],
    "n_date": ["1999-02-28", "2199-12-31"],
    "n_ssn": ["123-45-6789", "665-01-0001"],
}
DECOYS = ["4337166598464398", "999.1.1.1", "1999-02-30", "666-45-6789", "000-12-3456", "12345", "1.2.3", "a@b", "x4337166598464399", "4337166598464399x"]


def test_pseudonyms_keep_formats_and_links(docs):
    finds = [(k, f) for k, fs in FINDS.items() for f in fs]
    rows = [(i, f"Before {f}, after.\n") for i, (_, f) in enumerate(finds)] + [(100 + i, f"Before {d} after") for i, d in enumerate(DECOYS)]
    rows += [(200, " | ".join(f for _, f in finds)), (201, None), (202, ""), (203, "x " * 20_000 + "17.252.227.210"), (None, "17.252.227.210")]
    got = {r.doc_id: r for r in pii.pseudonymise(docs(rows, extra=True), key="k1").collect()}
    new = {}
    for i, (kind, f) in enumerate(finds):
        r = got[i]
        assert r[kind] == 1 and sum(r[k] for k in FINDS) == 1
        new[f] = r.text[len("Before ") : -len(", after.\n")]
        shape = lambda s: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub(r"\d", "9", s)))
        assert new[f] != f and (kind == "n_ip" or shape(new[f].split("@")[0]) == shape(f.split("@")[0]))
    assert got[200].text == " | ".join(new[f] for _, f in finds)
    assert all(luhn(new[f]) for f in FINDS["n_card"]) and len({re.sub(r"\D", "", new[f]) for f in FINDS["n_card"]}) == 1
    assert all(max(map(int, new[f].split("."))) < 256 for f in FINDS["n_ip"])
    assert all(dt.date(1800, 1, 1) <= dt.date.fromisoformat(new[f]) <= dt.date(2199, 12, 31) for f in FINDS["n_date"])
    assert all(got[100 + i].text == f"Before {d} after" for i, d in enumerate(DECOYS))
    assert (got[201].text, got[202].text, got[203].text.split()[-1], got[None].text) == (None, "", new["17.252.227.210"], new["17.252.227.210"])
    other = {r.doc_id: r.text for r in pii.pseudonymise(docs(rows[:1]), key="another").collect()}
    assert other[0] != got[0].text and pii.pseudonymise(docs([]), key="k").count() == 0


def feistel_number(x, p, q, key, kind):
    a, b = divmod(x, q)
    for i in range(1, 9):
        number = lambda other: int(hashlib.sha256(f"{key}|{kind}|{i}|{other}".encode()).hexdigest()[:12], 16)  # noqa: B023, E731
        a, b = ((a + number(b)) % p, b) if i % 2 else (a, (b + number(a)) % q)
    return a * q + b


def feistel_text(s, key, kind):
    a, b = s[: len(s) // 2], s[len(s) // 2 :]
    for i in range(1, 9):
        digest = hashlib.sha256(f"{key}|{kind}|{i}|{b}".encode()).hexdigest()
        moved = ""
        for j, c in enumerate(a):
            for first, size in (("0", 10), ("a", 26), ("A", 26)):
                if ord(first) <= ord(c) < ord(first) + size:
                    c = chr((ord(c) - ord(first) + int(digest[j % 32 * 2 : j % 32 * 2 + 2], 16)) % size + ord(first))
                    break
            moved += c
        a, b = b, moved
    return a + b


def expected(kind, find, key):
    digits = re.sub(r"\D", "", find)
    lay = lambda new: re.sub(r"\d", lambda m, it=iter(new): next(it), find)
    if kind == "email":
        return feistel_text(find.split("@")[0], key, kind) + "@" + find.split("@")[1]
    if kind == "phone":
        return lay(digits[:-10] + feistel_text(digits[-10:], key, kind))
    if kind == "card":
        body = feistel_text(digits[:-1], key, kind)
        return lay(next(body + str(c) for c in range(10) if luhn(body + str(c))))
    if kind == "ip":
        x = feistel_number(int.from_bytes(map(int, find.split(".")), "big"), 65536, 65536, key, kind)
        return ".".join(map(str, x.to_bytes(4, "big")))
    if kind == "date":
        return str(dt.date(1800, 1, 1) + dt.timedelta(feistel_number((dt.date.fromisoformat(find) - dt.date(1800, 1, 1)).days, 189, 773, key, kind)))
    areas = [a for a in range(1, 900) if a != 666]
    area, group, serial = map(int, find.split("-"))
    x = feistel_number((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, kind)
    return f"{areas[x // (99 * 9999)]:03d}-{x // 9999 % 99 + 1:02d}-{x % 9999 + 1:04d}"


def test_pseudonyms_equal_a_plain_feistel_network(docs):
    rng = random.Random(12)
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    finds = [(k[2:], f) for k, fs in FINDS.items() for f in fs]
    for _ in range(6):
        body = d(14)
        amex = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        finds += [("card", amex), ("card", f"{amex[:4]} {amex[4:10]} {amex[10:]}"), ("card", f"{amex[:4]}-{amex[4:10]}-{amex[10:]}")]
        finds += [("phone", f"({d(3)}) {d(3)}-{d(4)}"), ("ip", ".".join(str(rng.randrange(256)) for _ in range(4))), ("email", f"{rng.choice('abcXYZ')}{d(2)}_q@h{d(1)}.net")]
        finds += [("date", str(dt.date(1800, 1, 1) + dt.timedelta(rng.randrange(146097)))), ("ssn", f"{rng.choice([1, 665, 667, 899]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}")]
    rows = [(i, f"a {f}, b {f}!") for i, (_, f) in enumerate(finds)]
    rows += [(1000 + i, f"\x01 a {f}\x01\x01 b {f}") for i, (_, f) in enumerate(finds)]  # the mark itself in the text
    got = {r.doc_id: r for r in pii.pseudonymise(docs(rows), key="my key").collect()}
    for i, (kind, f) in enumerate(finds):
        new = expected(kind, f, "my key")
        assert got[i].text == f"a {new}, b {new}!" and got[1000 + i].text == f"\x01 a {new}\x01\x01 b {new}", (kind, f)
        assert got[i][f"n_{kind}"] == 2 == got[1000 + i][f"n_{kind}"]
    with pytest.raises(TypeError):
        pii.pseudonymise(docs([]))


def test_networks_are_permutations(spark):
    n = spark.range(189 * 7).select(pii.permuted_number(F.col("id"), (189, 7), "k", "t").alias("p"))
    assert {r.p for r in n.collect()} == set(range(189 * 7))
    s = spark.range(1000).select(pii.permuted_text(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("p"))
    assert {r.p for r in s.collect()} == {f"{i:03d}" for i in range(1000)}
    one = spark.createDataFrame([("",), ("7",), ("é-",)], "s string").select(pii.permuted_text(F.col("s"), "k", "t")).collect()
    assert (one[0][0], len(one[1][0]), one[2][0]) == ("", 1, "é-")
