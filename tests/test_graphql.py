import pytest

from trellis.operators import indexes
from trellis.plans import graphql
from trellis.sources.tables import graph


def test_roots(spark, sf):
    g = graph(spark, sf)
    indexes.create_index(g, "v", "exact", spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, embedding array<double>"))
    got = g.graphql('{ n: cypher(query: "MATCH (n:Nation) RETURN count(n) AS n") near: semanticSearch(index: "v", vector: [1, 0.1], limit: 1) { id } nodes(where: {id: "Nation:3"}) { id labels n_name } }')
    assert got["n"].collect()[0].n == 25 and got["near"].collect()[0].id == "a"
    assert [tuple(r) for r in got["nodes"].collect()] == [("Nation:3", ["Nation"], "NATION_3")]


def test_two_levels_and_missing_lists(spark, sf):
    rows = graph(spark, sf).graphql('{ Customer(where: {c_custkey: 5}) { id out(type: "IN_NATION") { id out(type: "IN_REGION") { r_name } } in(type: "PLACED") { id } } }')["Customer"].collect()
    assert len(rows) == 1 and len(rows[0].out) == 1 and rows[0].out[0].out[0].r_name and rows[0]["in"] is None


def test_errors_and_schema(spark, sf):
    g = graph(spark, sf)
    for bad in ("mutation { x }", "{ Nobody { id } }", "{ Nation { nothing } }", "{ Nation ("):
        with pytest.raises((graphql.GraphQLError, IndexError)):
            g.graphql(bad)
    assert "type Nation {" in graphql.schema(g) and "n_nationkey: Int" in graphql.schema(g)
    assert g.status()["types"][0] == "BASED_IN"
