"""Cases planted in whole tables: passages above and below 400 bytes, exact and near copies, clean documents among them."""

import random

from pyspark.sql import functions as F

from tessera.llm import odd_sketch, suffix_dedup
from test_operators import DOCS, suffix_brute

random.seed(21)
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def words(n, low=4, high=7):
    return " ".join("".join(random.choices(LETTERS, k=random.randint(low, high))) for _ in range(n))


def table(spark, tmp_path, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    d.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_passages_of_over_fifty_words(spark, tmp_path):
    """A repeated passage goes once it fills a window of 400 bytes; one of over 50 words that is shorter than that stays, as the window says; clean documents lose nothing."""
    plans = {f"{n} words": words(n) for n in (51, 60, 70, 85, 120, 300)}
    rows, where = [(i, words(150)) for i in range(40)], {}
    for p, (name, passage) in enumerate(plans.items()):
        for c in range(5):
            doc = 1000 + 10 * p + c
            rows.append((doc, words(random.randint(5, 60)) + " " + passage + " " + words(random.randint(5, 60))))
            where[doc] = passage
    got = {r["doc_id"]: r for r in suffix_dedup.query(spark, table(spark, tmp_path, rows)).collect()}
    assert all(got[i]["n_removed"] == 0 for i in range(40))
    above = {d for d, p in where.items() if len(p.encode()) >= 400}
    assert len(above) == 20 and {len(p.split()) for p in plans.values() if len(p.encode()) < 400} == {51, 60}
    for d, p in where.items():
        n = len(p.encode())
        # the space on either side of a passage is shared too, and chance may share a letter more
        if d in above:
            assert n <= got[d]["n_removed"] <= n + 4
        elif n < 394:
            assert got[d]["n_removed"] == 0


def test_copies_and_near_copies(spark, tmp_path):
    base = [words(200) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    near = {}
    for i, t in enumerate(base):
        w = t.split()
        for c, edits in enumerate((0, 1, 2)):
            x = list(w)
            for at in random.sample(range(10, 190, 20), edits):
                x[at] = "edited"
            near[100 + 10 * i + c] = i
            rows.append((100 + 10 * i + c, " ".join(x).upper() if c == 0 else " ".join(x)))
        far = list(w)
        for at in range(3, 200, 20):
            far[at] = "changed"
        rows.append((500 + i, " ".join(far)))
    got = {r["doc_id"]: r for r in odd_sketch.query(spark, table(spark, tmp_path, rows)).collect()}
    assert all(got[d]["component_id"] == i and not got[d]["kept"] for d, i in near.items())
    assert all(got[i]["kept"] for i in range(12)) and all(got[500 + i]["kept"] for i in range(12))


def test_shorter_strings_where_the_length_says_so(spark):
    """The operator's length decides: below the contract's 400 bytes a passage of 51 words goes from each text that holds it, and all else stays."""
    rng = random.Random(7)
    some = lambda n: " ".join("".join(rng.choices(LETTERS, k=rng.randint(4, 7))) for _ in range(n))
    passage = some(51)
    rows = [(i, some(20) + f" {i}! " + passage + f" !{i} " + some(30)) for i in range(4)] + [(10 + i, some(60)) for i in range(6)]
    assert 250 < len(passage) < 390
    d = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long").repartition(3)
    at = lambda n: {r["doc_id"]: r["text"] for r in suffix_dedup.remove_repeats(d, n).collect()}
    assert at(400) == dict(rows) and at(250) == {i: t.replace("! " + passage + " !", "") for i, t in rows}
    d = spark.createDataFrame(DOCS, "doc_id long, text string, source string").repartition(3)
    assert sorted(map(tuple, suffix_dedup.digests(d, 250).collect()), key=str) == suffix_brute(DOCS, 250)


def test_passages_of_the_benchmark(spark, sf, tmp_path):
    """The passages of over 50 words in the given tables are shorter than a window: documents that share one lose nothing, and the query removes what windows cover, no more and no less."""
    rng = random.Random(8)
    some = lambda: " ".join("".join(rng.choices(LETTERS, k=rng.randint(4, 7))) for _ in range(30))
    long = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if len(r["text"].encode().split()) > 50]
    assert long and all(len(p.encode()) < 396 for p in long)
    planted = [(-1 - i, f"{some()} {i} {p} {i} {some()}") for i, p in enumerate(long * 3)]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + planted
    got = sorted(map(tuple, suffix_dedup.query(spark, table(spark, tmp_path, rows)).collect()), key=str)
    assert got == suffix_brute([(*r, None) for r in rows]) and len(planted) == sum(r[0] < 0 and r[2] == 0 for r in got) and any(r[2] for r in got)
