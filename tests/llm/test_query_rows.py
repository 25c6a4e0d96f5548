import pytest

from clauseloom.llm import ann, topk


@pytest.mark.parametrize("search", [ann.nearest, topk.top_products])
def test_repeated_query_rows(spark, search):
    schema = "vec_id long, embedding array<float>"
    vectors = spark.createDataFrame([(i, [1.0 + i / 8, 2.0 - i / 16]) for i in range(12)], schema)
    asked = [(3, [1.0, 0.5]), (3, [1.0, 0.5]), (4, [1.0, 2.0]), (4, [-2.0, 1.0])]

    def hits(rows):
        found = search(vectors, spark.createDataFrame(rows, schema), k=4).collect()
        return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found)

    alone = [hits([row]) for row in asked]
    assert all([r[1] for r in x] == [1, 2, 3, 4] and len({r[2] for r in x}) == 4 for x in alone)
    assert hits(asked) == sorted(alone[1] + alone[2] + alone[3])
