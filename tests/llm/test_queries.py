import pytest

from loomgraph.llm.queries import QUERIES

COLUMNS = {
    "p3_found": {"question_a", "question_b"}, "p3_report": {"split", "kg_id", "n_pairs", "n_slipped"}, "p5_found": {"field", "id_a", "id_b"}, "p5_entities": {"record_id", "person_id"}, "p7_found": {"chunk_a", "chunk_b"}, "p7_recall": {"min_cosine", "n_true", "n_found", "recall"},
    "p8_contexts": {"context_id", "slot", "bucket", "doc_id", "piece", "token_from", "token_to", "n_tokens"}, "p8_report": {"bucket", "n_contexts", "n_pieces", "n_cuts", "n_least", "fill"}, "p9_found": {"doc_id", "item_id"}, "p9_report": {"benchmark", "n_items", "n_documents", "n_with_answer", "longest"}, "p10_found": {"doc_id", "subject"}, "p10_composition": {"subject", "n_documents", "mean_share"},
}
#: The smallest data may hold no overlapping question, no leak and no near vector.
MAY_BE_EMPTY = {"p3_found", "p3_report", "p7_found", "p7_recall", "p9_found", "p9_report"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, root, name):
    df = QUERIES[name](spark, root)
    rows = df.collect()
    assert set(df.columns) == COLUMNS[name] and (rows or name in MAY_BE_EMPTY)
    assert len(rows) == len({tuple(r) for r in rows})


def test_all_have_their_columns():
    assert set(QUERIES) == set(COLUMNS)
