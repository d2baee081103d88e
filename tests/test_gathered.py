"""Work that is gathered before it is shuffled, written or put into a state."""

from __future__ import annotations

from pyspark.sql import Row
from pyspark.sql import functions as F

from quarry.operators import blocks, inverted, search
from quarry.streaming import live


def test_postings_of_a_term_are_gathered_in_their_task(spark):
    rows = search.with_tokens(spark.createDataFrame([(i, "a b a" if i % 2 else "b") for i in range(100)], "id long, text string").coalesce(1)).select("id", "tokens")
    parts = {r.term: r for r in inverted.posting_parts(rows, 4).collect()}
    assert parts.keys() == {"a", "b"} and parts["a"].n == 50 and parts["b"].total == 100
    assert {tuple(p) for p in parts["b"].front} == {(1, 1)} and {tuple(p) for p in parts["a"].front} == {(2, 3)}
    found = {(r.term, r.id): (r.d, r.f, list(r.positions)) for r in inverted.listed(inverted.posting_parts(rows, 4), "term", positions=True).collect()}
    assert len(found) == 150 and found["a", 1] == (3, 2, [0, 2]) and found["b", 1] == (3, 1, [1]) and found["b", 2] == (1, 1, [0])


def test_blocks_are_made_without_a_shuffle(spark):
    rows = spark.range(5000).select(F.col("id").alias("docno"), F.array(F.lit("w"), (F.col("id") % 3).cast("string")).alias("tokens"))
    made = blocks.posting_blocks(rows)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.where("term = 'w'").agg(F.sum("n")).first()[0] == 5000


class States:
    """A value and a list that count how often they are called."""

    def __init__(self):
        self.calls, self.value, self.rows, self.timers = 0, None, [], []

    def __getattr__(self, name):
        def call(*given):
            self.calls += 1
            if name == "update":
                self.value = given[0]
            elif name == "appendList":
                self.rows += given[0]
            elif name == "put":
                self.rows = list(given[0])
            elif name == "clear":
                self.rows = []
            elif name == "registerTimer":
                self.timers.append(given[0])

        return call


def test_a_batch_of_events_meets_the_state_once():
    debounce, files, burst, handle = live.Debounce(4000, True), States(), States(), States()
    burst.get = lambda: burst.value
    files.get = lambda: iter(files.rows)
    debounce.handle, debounce.files, debounce.burst = handle, files, burst
    batch = lambda first, n: [Row(us=(first + i) * 1_000_000, event_id=i, file=f"f{i % 7}", event=f"e{i}") for i in range(n)]
    assert list(debounce.handleInputRows(("d",), iter(batch(0, 1000)), None)) == []
    assert files.calls + burst.calls + handle.calls <= 4 and len(files.rows) == 7
    for k in range(1, 100):  # one burst over many batches: the list stays short
        list(debounce.handleInputRows(("d",), iter(batch(1000 * k, 1000)), None))
        assert len(files.rows) <= 2 * 7 + live.LIST_ROWS + 7
    closed = list(debounce.handleInputRows(("d",), iter(batch(200_000, 1)), None))
    assert sorted((r.burst, r.file, r.event) for r in closed) == sorted((1, f"f{i % 7}", f"e{i}") for i in range(993, 1000)) and [r[0] for r in files.rows] == ["f0"]


def test_vector_queries_hand_on_their_best_only(spark, monkeypatch):
    """A task over many batches hands on `limit` rows a query, however many batches and ties it meets."""
    rows = spark.range(6000, numPartitions=1).select("id", F.array(F.lit(1.0), (F.col("id") % 50).cast("double")).alias("embedding"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        found = search.vector_topk_many(rows, [(7, [1.0, 0.0]), (8, [0.0, 1.0])], 5)
        best = {q: [r.id for r in found.where(F.col("query_id") == q).orderBy("rank").collect()] for q in (7, 8)}
        assert best == {7: [0, 50, 100, 150, 200], 8: [49, 99, 149, 199, 249]}
        hits = found._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in hits
        one = next(iter([search._best_of(None, [search.pa.table({"query": [0] * 9, "score": [1.0] * 9, "id": list(range(9, 0, -1))})], 3)]))
        assert one.column("id").to_pylist() == [1, 2, 3]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
