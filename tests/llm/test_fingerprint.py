import hashlib

from pyspark.sql import functions as F

from verdara.llm import fingerprint as P


def prints(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in rows.select("i", P.lanes(F.col("t")).alias("f")).orderBy("i").select("f").collect()]


def test_sums_of_paragraphs(spark):
    a, b, ab, ba, c = prints(spark, ["first one. second; third", "another | line?",
                                     "first one. second; third\nanother | line?",
                                     "another | line?\nfirst one. second; third", "first one. second; thirD"])
    assert ab == ba and ab != a and a != c
    assert [(x + y) & P.MASK for x, y in zip(a, b)] == ab
    row = spark.createDataFrame([(a, b, ab)], "a array<long>, b array<long>, ab array<long>")
    got = row.select(P.add(F.col("a"), F.col("b")), P.subtract(F.col("ab"), F.col("b"))).first()
    assert list(got[0]) == ab and list(got[1]) == a


def test_likeness_follows_the_shared_part(spark):
    def text(*ranges):
        return ". ".join(f"clause {i} {i * i}" for r in ranges for i in range(*r))

    for size in (40, 4000):
        base, half, none = text((0, size)), text((0, size // 2), (10 ** 6, 10 ** 6 + size // 2)), text((2 * 10 ** 6, 2 * 10 ** 6 + size))
        rows = spark.createDataFrame([(base, x) for x in (base, half, none)], "a string, b string")
        near = [r[0] for r in rows.select(P.likeness(P.lanes(F.col("a")), P.lanes(F.col("b")))).collect()]
        assert near[0] == 1.0 and 0.25 < near[1] < 0.75 and near[2] < 0.3


def expect(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, (k, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        out.append((k, len(t), hashlib.sha256((t[:len(t) - half] + after[:half]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_edited_texts(edge_docs, no_docs, edge_rows, spark):
    got = P.edited_documents(edge_docs).collect()
    assert sorted([(r[0], r[1], r[2]) for r in got], key=str) == expect([(k, t) for k, t, _ in edge_rows])
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert by_text[1] == by_text[8] and len(by_text[5]) == 1
    assert P.edited_documents(no_docs).collect() == []
    one = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert [(r["edited_sha256"], r["near_next"]) for r in P.edited_documents(one).collect()] == [
        (hashlib.sha256(b"aba").hexdigest(), 1.0)]


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(P, "ROWS_PER_RANGE", 3)
    monkeypatch.setattr(P, "CUTS", 4)
    rows = [(i * i, f"text {i}. and more\nline {i % 3}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = P.edited_documents(docs).collect()
    assert sorted([(r[0], r[1], r[2]) for r in got], key=str) == expect(rows)
