"""Cases of the fourth review."""


def test_equal_rows_are_compared_once(spark, monkeypatch):
    """Each of the equal rows of an id was a text of its block, whatever the block's bound."""
    from plumbline.llm import near_dedup

    seen, compared = [], near_dedup.linked_components

    def counted(members, payload, *rest):
        seen.append(sorted((r.doc_id, r.n) for r in payload.groupBy("doc_id").count().withColumnRenamed("count", "n").collect()))
        return compared(members, payload, *rest)

    monkeypatch.setattr(near_dedup, "linked_components", counted)
    words = [f"w{i}" for i in range(60)]
    text = lambda *gone: " ".join(w for i, w in enumerate(words) if i not in gone)
    rows = [(1, text())] * 50 + [(2, text(0))] * 30 + [(3, text(59))] + [(4, "another text that is like none of them")] * 5
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4)
    assert sorted((r.doc_id, r.component_id) for r in out.collect()) == [(i, 4 if i == 4 else 1) for i, _ in sorted(rows)]
    assert seen[-1] == [(1, 1), (2, 1), (3, 1)]
