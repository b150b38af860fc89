import pytest

from trellis.plans.cypher import CypherError
from trellis.plans.graph import EdgeTable, Graph, NodeTable
from trellis.plans.updates import Session


@pytest.fixture()
def g(spark):
    people = spark.createDataFrame([("a", "Ann", 30), ("b", "Bo", 40), ("c", "Cy", None)], "id string, name string, age int")
    return Graph(spark, {"Person": NodeTable(people)}, {"KNOWS": EdgeTable(spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0)], "s string, o_id string, weight double"))})


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_create_nodes_and_relationships(g):
    done = g.update("CREATE (d:Person:Staff {id: 'd', name: 'Di'})-[r:KNOWS {weight: 3.5}]->(e:Person {name: 'Ed', age: 5}) RETURN d.name AS d, e.age AS e, r.weight AS w")
    assert rows(done.df.select("d", "e")) == [("Di", 5)]
    assert rows(done.graph.cypher("MATCH (x:Person) RETURN count(*) AS n")) == [(5,)]
    assert rows(done.graph.cypher("MATCH (x:Person:Staff)-[r:KNOWS]->(y:Person) RETURN x.id AS x, y.name AS y, r.weight AS w")) == [("d", "Ed", 3.5)]
    assert g.cypher("MATCH (x:Person) RETURN count(*) AS n").collect()[0].n == 3  # the old version stays


def test_create_for_each_row(g):
    done = g.update("MATCH (p:Person) WHERE p.age >= 30 CREATE (p)-[:HAS]->(b:Badge {of: p.name})")
    assert rows(done.graph.cypher("MATCH (p)-[:HAS]->(b:Badge) RETURN p.id AS p, b.of AS o")) == [("a", "Ann"), ("b", "Bo")]


def test_merge(g):
    text = "UNWIND ['Ann', 'New', 'New'] AS n MERGE (p:Person {name: n}) ON CREATE SET p.age = 1 ON MATCH SET p.age = 99 RETURN p.name AS n, p.age AS age"
    done = g.update(text)
    assert rows(done.df) == [("Ann", 99), ("New", 1), ("New", 1)]
    assert done.graph.nodes["Person"].df.count() == 4
    again = done.graph.update("MATCH (x:Person {id: 'a'}), (y:Person) WHERE y.name IN ['Bo', 'New'] MERGE (x)-[r:KNOWS]->(y) ON CREATE SET r.weight = 7.0 ON MATCH SET r.weight = 8.0")
    assert rows(again.graph.cypher("MATCH (x {id: 'a'})-[r:KNOWS]->(y:Person) RETURN y.name AS y, r.weight AS w")) == [("Bo", 8.0), ("New", 7.0)]


def test_set_remove_and_labels(g):
    done = g.update("MATCH (p:Person) WHERE p.age > 30 SET p.age = p.age + 1, p += {name: 'X', nick: 'x'}, p:Old RETURN p.age AS age, p.name AS n")
    assert rows(done.df) == [(41, "X")]
    assert rows(done.graph.cypher("MATCH (p:Old) RETURN p.id AS id, p.nick AS k")) == [("b", "x")]
    done = done.graph.update("MATCH (p:Old) REMOVE p.age, p:Old")
    assert done.graph.nodes["Old"].df.isEmpty()
    assert rows(done.graph.cypher("MATCH (p:Person) WHERE p.age IS NULL RETURN p.id AS id")) == [("b",), ("c",)]
    # several rows set one property: the greatest stays
    assert rows(g.update("UNWIND [3, 9, 5] AS v MATCH (p:Person {id: 'a'}) SET p.age = v").graph.cypher("MATCH (p:Person {id: 'a'}) RETURN p.age AS a")) == [(9,)]
    assert rows(g.update("MATCH (:Person {id: 'a'})-[r:KNOWS]->() SET r.weight = 5.0").graph.cypher("MATCH (a)-[r:KNOWS]->(b) RETURN a.id AS a, r.weight AS w")) == [("a", 5.0), ("b", 2.0)]


def test_delete(g):
    with pytest.raises(CypherError):
        g.update("MATCH (p:Person {id: 'a'}) DELETE p")
    done = g.update("MATCH (p:Person {id: 'a'}) DETACH DELETE p")
    assert (done.graph.nodes["Person"].df.count(), rows(done.graph.edges["KNOWS"].df)) == (2, [("b", "c", 2.0)])
    assert rows(g.update("MATCH (a)-[r:KNOWS]->(b) WHERE r.weight > 1 DELETE r").graph.edges["KNOWS"].df) == [("a", "b", 1.0)]


def test_foreach_scripts_and_subqueries(g):
    done = g.update("MATCH (p:Person {id: 'a'}) FOREACH (x IN [1, 2] | CREATE (t:Tag {n: x}) CREATE (p)-[:TAGGED]->(t)) RETURN p.name AS n")
    assert rows(done.df) == [("Ann",)]
    assert rows(done.graph.cypher("MATCH (p)-[:TAGGED]->(t:Tag) RETURN p.id AS p, t.n AS n")) == [("a", 1), ("a", 2)]
    done = g.update("CREATE (:City {id: 'x', name: 'X'}); MATCH (p:Person), (c:City) CREATE (p)-[:IN]->(c); MATCH (p)-[:IN]->(c:City) RETURN c.name AS c, count(p) AS n")
    assert rows(done.df) == [("X", 3)]
    done = g.update("MATCH (p:Person) CALL { WITH p CREATE (:Copy {of: p.id}) } IN TRANSACTIONS OF 2 ROWS RETURN count(p) AS n")
    assert rows(done.df) == [(3,)] and done.graph.nodes["Copy"].df.count() == 3


def test_transactions(g):
    s = Session(g)
    s.begin()
    s.run("CREATE (:Person {id: 'z'})")
    assert s.graph.nodes["Person"].df.count() == 4
    s.rollback()
    assert s.graph.nodes["Person"].df.count() == 3
    s.begin()
    s.run("CREATE (:Person {id: $id})", id="y")
    s.commit()
    assert s.graph.nodes["Person"].df.count() == 4
    with pytest.raises(CypherError):
        s.commit()


def test_show_explain_and_schema(g):
    assert "graph.pagerank" in {r.name for r in g.cypher("SHOW PROCEDURES").collect()}
    assert any("Scan" in r.plan for r in g.cypher("EXPLAIN MATCH (p:Person) RETURN p.name AS n").collect())
    assert g.cypher("CREATE INDEX name_ix IF NOT EXISTS FOR (p:Person) ON (p.name)").isEmpty()
    with pytest.raises(CypherError):
        g.cypher("CREATE (x:Person)")
