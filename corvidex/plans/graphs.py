"""Graph queries over edges derived from the relational tables: customer, nation, region, part, supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvidex.operators import betweenness as B
from corvidex.operators import communities as C
from corvidex.operators import extraction as X
from corvidex.operators import flows as W
from corvidex.operators import graph as G
from corvidex.plans.base import Tables, query
from corvidex.sources.tables import dealt

_EDGES = """e AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""


def places(t: Tables) -> DataFrame:
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c))
    a = t.customer.select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst"))
    b = t.supplier.select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst"))
    return a.union(b).union(t.nation.select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst")))


def weighted_supply(lines: DataFrame) -> DataFrame:
    """src (supplier), dst (part), n: the number of ``lines`` that name both."""
    return dealt(lines, lines.count(), "l_suppkey", "l_partkey").groupBy(F.col("l_suppkey").cast("long").alias("src"), (1_000_000 + F.col("l_partkey")).cast("long").alias("dst")).agg(F.count("*").alias("n"))


def supply(t: Tables) -> DataFrame:
    return weighted_supply(t.lineitem).select("src", "dst")


@query(f"WITH {_EDGES} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1 ORDER BY degree DESC, id LIMIT 10")
def degree_hubs(t: Tables) -> DataFrame:
    return G.hubs(places(t), 10)


@query(f"""WITH RECURSIVE {_EDGES}, w AS (SELECT 'r1' AS id, 0 AS depth UNION SELECT e.src, w.depth + 1 FROM w JOIN e ON e.dst = w.id WHERE w.depth < 3)
SELECT id, min(depth) AS depth FROM w GROUP BY 1""")
def blast_radius(t: Tables) -> DataFrame:
    seeds = t.spark.createDataFrame([("r1",)], "id string")
    return G.frontier(places(t), seeds, 3, reverse=True)


@query("""SELECT unnest([0, 1, 2, 3]) AS step, unnest(['c' || (SELECT min(c_custkey) FROM customer), 'n' || (SELECT arg_min(c_nationkey, c_custkey) FROM customer),
'r' || (SELECT n_regionkey FROM nation WHERE n_nationkey = (SELECT arg_min(c_nationkey, c_custkey) FROM customer)),
'n' || (SELECT CAST(n AS VARCHAR) FROM (SELECT max(n_nationkey) AS n FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = (SELECT arg_min(c_nationkey, c_custkey) FROM customer)) AND n_nationkey <> (SELECT arg_min(c_nationkey, c_custkey) FROM customer)))]) AS id""")
def shortest_path(t: Tables) -> DataFrame:
    first = t.customer.orderBy("c_custkey").limit(1).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).first()
    other = t.nation.where((F.col("n_regionkey") == first["n_regionkey"]) & (F.col("n_nationkey") != first["n_nationkey"])).agg(F.max("n_nationkey")).first()[0]
    return G.shortest_path(places(t), f"c{first['c_custkey']}", f"n{other}")


@query()
def connected_components(t: Tables) -> DataFrame:
    """Against union-find in the tests: a recursive CTE walks all pairs."""
    return G.components(supply(t))


_ROUND = """v{k} AS (SELECT src AS id, label, sum(n) AS n FROM u JOIN l{j} ON dst = id GROUP BY 1, 2),
l{k} AS (SELECT l{j}.id, CASE WHEN m.n > 1 THEN m.label ELSE greatest(m.label, l{j}.label) END AS label FROM l{j} JOIN (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, label DESC) AS k FROM v{k}) m ON l{j}.id = m.id AND k = 1)"""


@query(f"""WITH e AS (SELECT CAST(l_suppkey AS BIGINT) AS src, CAST(1000000 + l_partkey AS BIGINT) AS dst, count(*) AS n FROM lineitem GROUP BY 1, 2), u AS (SELECT src, dst, n FROM e UNION ALL SELECT dst, src, n FROM e),
l0 AS (SELECT DISTINCT src AS id, src AS label FROM u), {', '.join(_ROUND.format(k=k, j=k - 1) for k in (1, 2, 3))} SELECT id, label FROM l3""")
def label_propagation(t: Tables) -> DataFrame:
    """Three rounds over all part-supplier edges, each voting by its count; ``label_propagation_whole`` goes on to the end."""
    return G.label_propagation(weighted_supply(t.lineitem), 3, weight="n")


@query()
def label_propagation_whole(t: Tables) -> DataFrame:
    """All part-supplier edges by their counts, until nothing changes: against a plain loop in the tests."""
    return G.label_propagation(weighted_supply(t.lineitem), weight="n")


@query(f"WITH {_EDGES} SELECT id, max(layer) AS layer FROM (SELECT src AS id, CASE WHEN starts_with(src, 'n') THEN 1 ELSE 2 END AS layer FROM e UNION ALL SELECT dst, CASE WHEN starts_with(dst, 'r') THEN 0 ELSE 1 END FROM e) GROUP BY 1")
def scc_layers(t: Tables) -> DataFrame:
    return G.layers(places(t))


_LOOP = "e AS (SELECT DISTINCT c_nationkey AS src, CAST((c_nationkey * 7 + c_custkey % 3) % 25 AS INT) AS dst FROM customer)"


def loops(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("src"), ((F.col("c_nationkey") * 7 + F.col("c_custkey") % 3) % 25).cast("int").alias("dst")).distinct()


@query(f"""WITH RECURSIVE {_LOOP}, x AS (SELECT * FROM e WHERE src <> dst), w AS (SELECT [src, dst] AS p FROM x WHERE dst > src UNION ALL
SELECT list_append(p, x.dst) FROM w JOIN x ON x.src = p[-1] WHERE len(p) < 5 AND x.dst > p[1] AND NOT list_contains(p, x.dst))
SELECT DISTINCT array_to_string(p, '>') AS cycle FROM w JOIN x ON x.src = p[-1] AND x.dst = p[1]""")
def cycles_k5(t: Tables) -> DataFrame:
    return G.cycles(loops(t), 5).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("cycle"))


@query(f"""WITH RECURSIVE {_LOOP}, w AS (SELECT src AS a, dst AS b FROM e UNION SELECT w.a, e.dst FROM w JOIN e ON e.src = w.b), i AS (SELECT src AS id FROM e UNION SELECT dst FROM e)
SELECT i.id, greatest(i.id, coalesce(max(f.b), i.id)) AS component FROM i LEFT JOIN (SELECT w.a, w.b FROM w JOIN w r ON w.a = r.b AND w.b = r.a) f ON f.a = i.id GROUP BY 1""")
def strong_components(t: Tables) -> DataFrame:
    return G.strong_components(loops(t))


@query("""SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS weight FROM (SELECT c_nationkey AS x, s_nationkey AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
WHERE x <> y GROUP BY 1, 2 HAVING count(*) >= 2""")
def community_quotient(t: Tables) -> DataFrame:
    trade = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    groups = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_nationkey").alias("community")).union(t.supplier.select(F.concat(F.lit("s"), "s_suppkey"), "s_nationkey"))
    return G.quotient(trade, groups, 2)


@query(f"""WITH {_LOOP}, g AS (SELECT DISTINCT n_nationkey AS id, n_regionkey AS community FROM nation), p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst)
SELECT community, n, round(CASE WHEN n < 2 THEN 1.0 ELSE coalesce(c, 0) / (n * (n - 1) / 2) END, 6) AS cohesion FROM (SELECT community, count(*) AS n FROM g GROUP BY 1) LEFT JOIN
(SELECT x.community, count(*) AS c FROM p JOIN g x ON a = x.id JOIN g y ON b = y.id AND x.community = y.community GROUP BY 1) USING (community)""")
def cohesion(t: Tables) -> DataFrame:
    return G.cohesion(loops(t), t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("community")))


@query(f"""WITH {_EDGES}, d AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1)
SELECT e.src, e.dst, CASE WHEN substr(e.src, 1, 1) <> substr(e.dst, 1, 1) THEN 1 ELSE 0 END + CASE WHEN least(a.n, b.n) <= 2 AND greatest(a.n, b.n) >= 5 THEN 1 ELSE 0 END AS score
FROM (SELECT DISTINCT * FROM e) e JOIN d a ON e.src = a.id JOIN d b ON e.dst = b.id""")
def surprise_score(t: Tables) -> DataFrame:
    edges = places(t)
    groups = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("community", F.substring("id", 1, 1))
    return G.surprise(edges, groups)


@query("""SELECT 'removed' AS change, l_orderkey, l_partkey FROM (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_discount < 0.05 EXCEPT SELECT l_orderkey, l_partkey FROM lineitem WHERE l_tax < 0.04)
UNION ALL SELECT 'new', l_orderkey, l_partkey FROM (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_tax < 0.04 EXCEPT SELECT l_orderkey, l_partkey FROM lineitem WHERE l_discount < 0.05)""")
def graph_diff(t: Tables) -> DataFrame:
    from corvidex.operators.relational import diff

    rows = ("l_orderkey", "l_partkey")
    return diff(t.lineitem.where("l_discount < 0.05").select(*rows), t.lineitem.where("l_tax < 0.04").select(*rows))


@query("""SELECT DISTINCT o_custkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0) UNION SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_orderkey AND c_acctbal > 0)""")
def external_stubs(t: Tables) -> DataFrame:
    return G.mint_stubs(t.orders.select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst")), t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("id")))


@query("""SELECT id, label, 3 AS tier FROM (SELECT p_partkey AS id, p_name AS label FROM part) WHERE contains(lower(label), 'idge') ORDER BY id LIMIT 5""")
def node_resolution(t: Tables) -> DataFrame:
    return G.resolve(t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label")), "idge")


_TREE = """t AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'contains' AS rel FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'contains' FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'contains' FROM supplier
UNION ALL SELECT DISTINCT 'c' || o_custkey, 's' || l_suppkey, 'uses' FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


def named_tree(t: Tables) -> DataFrame:
    """src, dst, rel: regions contain nations, these customers and suppliers; customers use suppliers."""
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c))
    inside = lambda rows, a, x, b, y: rows.select(name(a, x).alias("src"), name(b, y).alias("dst"), F.lit("contains").alias("rel"))
    uses = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(name("c", "o_custkey").alias("src"), name("s", "l_suppkey").alias("dst"), F.lit("uses").alias("rel")).distinct()
    return inside(t.nation, "r", "n_regionkey", "n", "n_nationkey").union(inside(t.customer, "n", "c_nationkey", "c", "c_custkey")).union(inside(t.supplier, "n", "s_nationkey", "s", "s_suppkey")).union(uses)


def seeds_of(t: Tables, *ids: str) -> DataFrame:
    return t.spark.createDataFrame([(x,) for x in ids], "id string")


@query(f"""WITH RECURSIVE {_TREE}, w AS (SELECT 'r1' AS id, 0 AS depth UNION SELECT t.dst, w.depth + 1 FROM w JOIN t ON t.src = w.id WHERE rel = 'contains') SELECT id, min(depth) AS depth FROM w GROUP BY 1""")
def members_closure(t: Tables) -> DataFrame:
    return G.members(named_tree(t), seeds_of(t, "r1"))


@query(f"""WITH RECURSIVE {_TREE}, w AS (SELECT 'n3' AS id UNION SELECT t.dst FROM w JOIN t ON t.src = w.id WHERE rel = 'contains')
SELECT DISTINCT src AS id, 1 AS depth FROM t JOIN w ON dst = id WHERE rel = 'uses' AND src NOT IN (SELECT id FROM w)""")
def dependents_of_members(t: Tables) -> DataFrame:
    return G.dependents(named_tree(t), seeds_of(t, "n3"), 2, ["uses"])


_NEAR = """d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM g UNION ALL SELECT dst FROM g) GROUP BY 1),
b AS (SELECT greatest(50, list_sort(list(degree))[CAST(floor(count(*) * 0.99) AS INT) + 1]) AS bound FROM d),
u AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g), x AS (SELECT u.* FROM u JOIN d ON d.id = u.src CROSS JOIN b WHERE degree < bound OR src = 'c1'),
w AS (SELECT 'c1' AS id, 0 AS depth UNION SELECT x.dst, w.depth + 1 FROM w JOIN x ON x.src = w.id WHERE w.depth < 4)"""


@query(f"WITH RECURSIVE {_TREE}, g AS (SELECT src, dst FROM t WHERE rel = 'contains'), {_NEAR} SELECT id, min(depth) AS depth FROM w GROUP BY 1")
def bfs_with_hubs(t: Tables) -> DataFrame:
    edges = named_tree(t).withColumnRenamed("rel", "context")
    return G.around_seeds(edges, seeds_of(t, "c1"), 4, ["contains"])[0]


@query(f"""WITH RECURSIVE {_TREE}, g AS (SELECT src, dst FROM t), {_NEAR.replace('w.depth < 4', 'w.depth < 1')}, s AS (SELECT DISTINCT id FROM w)
SELECT src, dst, rel AS context FROM t WHERE src IN (SELECT id FROM s) AND dst IN (SELECT id FROM s)""")
def context_subgraph(t: Tables) -> DataFrame:
    edges = named_tree(t).withColumnRenamed("rel", "context")
    return G.around_seeds(edges, seeds_of(t, "c1"), 1)[1]


@query(f"""WITH RECURSIVE {_EDGES}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w AS (SELECT 'n5' AS id, 0 AS depth UNION SELECT u.dst, w.depth + 1 FROM w JOIN u ON u.src = w.id WHERE w.depth < 2),
m AS (SELECT id, min(depth) AS depth FROM w GROUP BY 1), d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1)
SELECT id, depth, degree FROM m JOIN d USING (id) ORDER BY depth, degree DESC, id LIMIT 40""")
def focus_neighbourhood(t: Tables) -> DataFrame:
    return G.focus(places(t), "n5", 40)


@query(f"""WITH {_TREE}, u AS (SELECT src, dst FROM t WHERE rel = 'uses'), z AS (SELECT DISTINCT dst FROM u WHERE src = 'c1')
SELECT src, dst FROM u WHERE src = 'c1' UNION SELECT src, dst FROM u WHERE dst = 'c1' UNION SELECT u.src, u.dst FROM u JOIN z ON u.dst = z.dst""")
def bfs_facts(t: Tables) -> DataFrame:
    uses = named_tree(t).where("rel = 'uses'").select("src", "dst")
    return G.facts_near(uses, seeds_of(t, "c1"), 2)


@query("""SELECT 'r' || n_regionkey AS id, 0 AS layer FROM nation UNION SELECT 'n' || n_nationkey, 1 FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation)
UNION SELECT 'c' || c_custkey, 2 FROM customer UNION SELECT 's' || s_suppkey, 2 FROM supplier""")
def condensed_layers(t: Tables) -> DataFrame:
    """The regions form a ring, which is one layer."""
    regions = t.nation.select("n_regionkey").distinct()
    ring = regions.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("r"), F.pmod(F.col("n_regionkey") + 1, F.lit(5))).alias("dst"))
    return G.condensed_layers(places(t).union(ring))


@query("""WITH d AS (SELECT o_custkey AS id, count(*) AS degree FROM orders GROUP BY 1), m AS (SELECT c_nationkey AS community, c_custkey AS id, c_name AS label, coalesce(degree, 0) AS degree FROM customer LEFT JOIN d ON d.id = c_custkey),
k AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY degree DESC, id) AS k FROM m)
SELECT community, max(label) FILTER (k = 1) AS name, count(*) AS size, string_agg(label, ',' ORDER BY k) FILTER (k <= 5) AS top FROM k GROUP BY 1""")
def community_areas(t: Tables) -> DataFrame:
    groups = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("community"))
    labels = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"))
    degrees = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("degree"))
    return G.areas(groups, degrees, labels).withColumn("top", F.array_join("top", ","))


@query()
def community_remap(t: Tables) -> DataFrame:
    """Communities by nation carried on from those by segment; against a greedy walk in the tests."""
    now = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("community"))
    before = t.customer.select(F.col("c_custkey").alias("id"), (F.ascii("c_mktsegment") * 1000 + F.length("c_mktsegment")).alias("community"))
    return G.remap(now, before)


@query("""SELECT count(DISTINCT p_partkey) AS nodes, count(DISTINCT p_size) AS communities FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_retailprice > 1500)""")
def pr_impact(t: Tables) -> DataFrame:
    files = t.part.where("p_retailprice > 1500").select(F.col("p_brand").alias("path"))
    return G.impact_of(files, t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("path")), t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("community")))


@query("""WITH x AS (SELECT 'n' || c_nationkey AS a, 'n' || s_nationkey AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
SELECT a AS src, b AS dst, count(*) AS weight FROM x WHERE a <> b GROUP BY 1, 2""")
def folder_dependencies(t: Tables) -> DataFrame:
    rows = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    path = lambda nation, kind, key: F.concat(F.lit("n"), nation, F.lit(f"/{kind}"), key)
    return G.folders(rows.select(path("c_nationkey", "c", "c_custkey").alias("src"), path("s_nationkey", "s", "s_suppkey").alias("dst")), 1)


@query("""WITH v AS (SELECT o_custkey AS id, s_nationkey AS community, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
b AS (SELECT id, arg_max(community, (n, -community)) AS near FROM v GROUP BY 1) SELECT c_custkey AS id, coalesce(CASE WHEN c_acctbal > 9000 THEN c_nationkey END, near) AS community FROM customer LEFT JOIN b ON id = c_custkey""")
def community_of_new(t: Tables) -> DataFrame:
    """Suppliers and rich customers are in the community of their nation; the others are new."""
    rows = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    edges = rows.select(F.col("o_custkey").alias("id"), (1_000_000_000 + F.col("l_suppkey")).alias("to"))
    groups = t.supplier.select((1_000_000_000 + F.col("s_suppkey")).alias("id"), F.col("s_nationkey").alias("community"))
    return G.community_of_new(t.customer.select(F.col("c_custkey").alias("id")), edges, groups.union(t.customer.where("c_acctbal > 9000").select("c_custkey", "c_nationkey")))


@query("SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders")
def saga_chain(t: Tables) -> DataFrame:
    return G.chain_by_time(t.orders, "o_custkey", "o_orderdate", "o_orderkey")


@query("""SELECT 'buyers' AS repo, 'buyers::' || c_custkey AS src, 'buyers::' || c_nationkey AS dst FROM customer UNION ALL SELECT 'sellers', 'sellers::' || s_suppkey, 'sellers::' || s_nationkey FROM supplier""")
def global_graph(t: Tables) -> DataFrame:
    """The buyers are added again, which replaces what they had."""
    edges = lambda rows, a, b: rows.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    held = G.namespaced({"buyers": edges(t.nation, "n_nationkey", "n_regionkey"), "sellers": edges(t.supplier, "s_suppkey", "s_nationkey")})
    return G.namespaced({"buyers": edges(t.customer, "c_custkey", "c_nationkey")}, held)


@query(f"""WITH {_TREE}, e AS (SELECT src, dst FROM t WHERE rel = 'contains'), d AS (SELECT id, count(*) AS r FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1), k AS (SELECT id FROM d ORDER BY r DESC, id LIMIT 12)
SELECT a AS src, b AS dst, count(*) AS weight FROM (SELECT CASE WHEN src IN (SELECT id FROM k) THEN src ELSE 'more' END AS a, CASE WHEN dst IN (SELECT id FROM k) THEN dst ELSE 'more' END AS b FROM e) WHERE a <> b GROUP BY 1, 2""")
def view_collapse(t: Tables) -> DataFrame:
    edges = named_tree(t).where("rel = 'contains'").select("src", "dst")
    return G.collapsed_view(edges, G.degree(edges).withColumnRenamed("degree", "rank"), 12, "more")


@query("""SELECT p_partkey AS id, CASE WHEN lower(p_name) = 'ol' THEN 0 ELSE 1 END AS tier FROM part WHERE contains(lower(p_name), 'ol') AND p_brand = 'Brand#2' ORDER BY tier, id LIMIT 5""")
def scoped_symbol(t: Tables) -> DataFrame:
    nodes = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.concat(F.lit("src/"), "p_brand").alias("path"))
    return G.scoped_symbol(nodes, "Brand#2::Ol")


@query("""WITH e AS (SELECT l_partkey AS src, 1000000 + l_suppkey AS dst, CASE l_returnflag WHEN 'R' THEN 'AMBIGUOUS' WHEN 'A' THEN 'INFERRED' ELSE 'EXTRACTED' END AS conf, CASE WHEN l_linestatus = 'O' THEN 'calls' WHEN l_tax > 0.06 THEN 'semantically_similar_to' ELSE 'imports' END AS rel FROM lineitem),
d AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1),
n AS (SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN 'code' ELSE 'document' END AS cat, p_brand AS folder, CASE WHEN p_size > 40 THEN 'python' WHEN p_size > 25 THEN 'web' ELSE 'other' END AS fam, p_size // 3 AS com FROM part
UNION ALL SELECT 1000000 + s_suppkey, 'code', 'Brand#' || (10 + s_nationkey), 'python', s_nationkey FROM supplier),
b AS (SELECT e.*, a.cat <> z.cat AS oc, a.folder <> z.folder AS f, a.com <> z.com AS oo, a.fam <> z.fam AND a.fam <> 'other' AND z.fam <> 'other' AS l, x.d AS dx, y.d AS dy FROM e JOIN n a ON a.id = src JOIN n z ON z.id = dst JOIN d x ON x.id = src JOIN d y ON y.id = dst),
s AS (SELECT *, CASE WHEN conf = 'INFERRED' AND rel = 'calls' AND (l OR oc) THEN 0 ELSE CASE conf WHEN 'AMBIGUOUS' THEN 3 WHEN 'INFERRED' THEN 2 ELSE 1 END + 2 * CAST(oc AS INT) + 2 * CAST(f AS INT) + CAST(oo AS INT) END AS s FROM b)
SELECT rel AS relation, CASE WHEN rel = 'semantically_similar_to' THEN CAST(floor(s * 1.5) AS BIGINT) ELSE s END + CASE WHEN least(dx, dy) <= 2 AND greatest(dx, dy) >= 5 THEN 1 ELSE 0 END AS score, count(*) AS n FROM s GROUP BY 1, 2""")
def surprise_full(t: Tables) -> DataFrame:
    conf = F.when(F.col("l_returnflag") == "R", "AMBIGUOUS").when(F.col("l_returnflag") == "A", "INFERRED").otherwise("EXTRACTED")
    rel = F.when(F.col("l_linestatus") == "O", "calls").when(F.col("l_tax") > 0.06, "semantically_similar_to").otherwise("imports")
    edges = t.lineitem.select(F.col("l_partkey").alias("src"), (1_000_000 + F.col("l_suppkey")).alias("dst"), conf.alias("confidence"), rel.alias("relation"))
    size = F.col("p_size")
    parts = t.part.select(F.col("p_partkey").alias("id"), F.when(size > 25, "code").otherwise("document").alias("category"), F.col("p_brand").alias("folder"), F.when(size > 40, "python").when(size > 25, "web").otherwise("other").alias("family"), F.floor(size / 3).cast("int").alias("community"))
    sellers = t.supplier.select((1_000_000 + F.col("s_suppkey")).alias("id"), F.lit("code").alias("category"), F.concat(F.lit("Brand#"), 10 + F.col("s_nationkey")).alias("folder"), F.lit("python").alias("family"), F.col("s_nationkey").cast("int").alias("community"))
    return G.surprise_full(edges, parts.union(sellers)).groupBy("relation", "score").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT l_partkey AS src, 1000000 + l_suppkey AS dst, l_returnflag FROM lineitem), g AS (SELECT 1000000 + s_suppkey AS dst, s_nationkey AS c FROM supplier UNION ALL SELECT p_partkey, 100 + p_size FROM part),
u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), d AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1)
(SELECT 'ambiguous' AS kind, src AS id FROM e WHERE l_returnflag = 'R' GROUP BY src ORDER BY count(*) DESC, src LIMIT 5) UNION ALL
(SELECT 'bridge', src FROM u JOIN g USING (dst) GROUP BY src HAVING count(DISTINCT c) > 1 ORDER BY count(DISTINCT c) DESC, src LIMIT 5) UNION ALL
(SELECT 'isolated', p_partkey FROM part LEFT JOIN d ON id = p_partkey WHERE coalesce(d, 0) <= 1 ORDER BY p_partkey LIMIT 5)""")
def open_questions(t: Tables) -> DataFrame:
    edges = t.lineitem.select(F.col("l_partkey").alias("src"), (1_000_000 + F.col("l_suppkey")).alias("dst"), F.when(F.col("l_returnflag") == "R", "AMBIGUOUS").otherwise("EXTRACTED").alias("confidence"))
    groups = t.supplier.select((1_000_000 + F.col("s_suppkey")).alias("id"), F.col("s_nationkey").alias("community")).union(t.part.select("p_partkey", 100 + F.col("p_size")))
    return G.open_questions(t.part.select(F.col("p_partkey").alias("id")), edges, groups)


@query()
def communities(t: Tables) -> DataFrame:
    """All part-supplier edges by their counts; the tests hold modularity against a plain single-machine run."""
    return C.communities(weighted_supply(t.lineitem), "n")


@query("SELECT count(DISTINCT id) AS nodes, count(DISTINCT id) AS placed, 0 AS disconnected FROM (SELECT l_suppkey AS id FROM lineitem UNION ALL SELECT 1000000 + l_partkey FROM lineitem)")
def communities_sound(t: Tables) -> DataFrame:
    """Every node in one community, and every community connected, counted from the communities themselves."""
    edges = weighted_supply(t.lineitem)
    found = C.written(C.communities(edges, "n"), "found")
    ends = found.groupBy("community").agg(F.count("*").alias("n"))
    parts = C.components(C.written(C._within(C.pairs_of(edges), found), "within")).join(found, "id").groupBy("community").agg(F.count_distinct("component").alias("parts"))
    broken = ends.join(parts, "community", "left").agg(F.count_if((F.col("n") > 1) & (F.coalesce("parts", F.lit(0)) != 1)).alias("disconnected"))
    return found.agg(F.count_distinct("id").alias("nodes"), F.count("*").alias("placed")).crossJoin(F.broadcast(broken))


@query(f"""WITH RECURSIVE {_LOOP}, u AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst),
w AS (SELECT src AS s, dst AS t, [src, dst] AS p FROM u UNION ALL SELECT w.s, u.dst, list_append(p, u.dst) FROM w JOIN u ON u.src = w.t WHERE len(p) < 6 AND NOT list_contains(p, u.dst)),
best AS (SELECT s, t, p FROM (SELECT *, min(len(p)) OVER (PARTITION BY s, t) AS m FROM w) WHERE len(p) = m), n AS (SELECT s, t, p, count(*) OVER (PARTITION BY s, t) AS n FROM best),
x AS (SELECT unnest(list_transform(range(1, len(p)), lambda i: [least(p[i], p[i + 1]), greatest(p[i], p[i + 1])])) AS edge, n FROM n), k AS (SELECT count(DISTINCT src) AS k FROM u)
SELECT edge[1] AS a, edge[2] AS b, round(sum(1.0 / n) / any_value(k * (k - 1)), 6) AS betweenness FROM x, k GROUP BY 1, 2""")
def edge_betweenness(t: Tables) -> DataFrame:
    return B.edge_betweenness(loops(t)).select("a", "b", F.round("betweenness", 6).alias("betweenness"))


@query("""WITH e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'holds' AS rule, n_nationkey AS rank FROM nation UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'within', -1 FROM nation
UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'sells', s_suppkey FROM supplier UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'buys', c_custkey FROM customer),
o AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY rank, dst, rule) AS k FROM e), w AS (SELECT src AS entry, 0 AS level, [k] AS key, src, dst, rule FROM o WHERE src[1] = 'r'),
x AS (SELECT w.entry, 1 AS level, list_append(w.key, o.k) AS key, o.src, o.dst, o.rule FROM w JOIN o ON o.src = w.dst)
SELECT entry, row_number() OVER (PARTITION BY entry ORDER BY level, key) AS position, level, src, dst, rule FROM (SELECT * FROM w UNION ALL SELECT * FROM x)""")
def flow_steps(t: Tables) -> DataFrame:
    """From every region through its nations, which also point back, to suppliers and customers."""
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c))
    edge = lambda rows, src, dst, rule, rank: rows.select(src.alias("src"), dst.alias("dst"), F.lit(rule).alias("rule"), rank.cast("long").alias("rank"))
    edges = edge(t.nation, name("r", "n_regionkey"), name("n", "n_nationkey"), "holds", F.col("n_nationkey")).union(edge(t.nation, name("n", "n_nationkey"), name("r", "n_regionkey"), "within", F.lit(-1)))
    edges = edges.union(edge(t.supplier, name("n", "s_nationkey"), name("s", "s_suppkey"), "sells", F.col("s_suppkey"))).union(edge(t.customer, name("n", "c_nationkey"), name("c", "c_custkey"), "buys", F.col("c_custkey")))
    entries = t.region.select(name("r", "r_regionkey").alias("entry"), name("r", "r_regionkey").alias("node"))
    through = t.nation.select(name("n", "n_nationkey").alias("id")).union(t.region.select(name("r", "r_regionkey")))
    return W.flows(entries, edges, through)


_FOUND = """i AS (SELECT 'P' || p_partkey AS id, p_name AS label, 'src/p' || p_size || '.py' AS file, 'ast' AS origin FROM part UNION ALL
SELECT 'S' || s_suppkey, s_name, 'src/n' || s_nationkey || CASE WHEN s_nationkey % 5 = 0 THEN '.ts' ELSE '.py' END, 'ast' FROM supplier UNION ALL
SELECT 'ghost_' || s_suppkey, s_name, 'src/n' || s_nationkey || CASE WHEN s_nationkey % 5 = 0 THEN '.ts' ELSE '.py' END, NULL FROM supplier WHERE s_nationkey < 12),
g AS (SELECT id, label, file, origin IS NOT NULL AS parsed, count_if(origin IS NOT NULL) OVER w AS k, coalesce(min(CASE WHEN origin IS NOT NULL THEN id END) OVER w, min(id) OVER w) AS canonical FROM i WINDOW w AS (PARTITION BY label, file)),
m AS (SELECT id, canonical FROM g WHERE NOT parsed AND k < 2 AND id <> canonical), n AS (SELECT * FROM i WHERE id NOT IN (SELECT id FROM m)),
c AS (SELECT regexp_replace(regexp_replace(lower(id), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS key, 0 AS tier, canonical AS id FROM m UNION ALL SELECT regexp_replace(regexp_replace(lower(id), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, id FROM n),
k AS (SELECT key, arg_min(id, (tier, id)) AS id FROM c GROUP BY 1),
r0 AS (SELECT 'p' || l_partkey AS src, CASE l_linenumber % 4 WHEN 1 THEN 'Ghost-' || l_suppkey WHEN 2 THEN 'ext.' || l_suppkey % 7 WHEN 3 THEN 'P' || l_partkey ELSE 'S' || l_suppkey END AS dst,
CASE l_returnflag WHEN 'R' THEN 'imports' WHEN 'A' THEN 'calls' ELSE 'references' END AS relation, CASE l_linestatus WHEN 'O' THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence,
CASE l_linestatus WHEN 'O' THEN NULL ELSE CAST(l_tax AS DOUBLE) END AS score, CASE WHEN l_discount < 0.03 THEN 1.0 ELSE CAST(l_discount AS DOUBLE) END AS weight FROM lineitem),
f AS (SELECT ref, coalesce(n.id, k.id) AS id FROM (SELECT src AS ref FROM r0 UNION SELECT dst FROM r0 UNION SELECT 'p' || l_partkey FROM lineitem) LEFT JOIN n ON n.id = ref LEFT JOIN k ON k.key = regexp_replace(regexp_replace(lower(ref), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')),
j AS (SELECT r0.*, a.id AS s, b.id AS d, x.file AS sf, y.file AS df FROM r0 JOIN f a ON a.ref = src JOIN f b ON b.ref = dst LEFT JOIN n x ON x.id = a.id LEFT JOIN n y ON y.id = b.id),
u AS (SELECT *, CASE WHEN relation = 'imports' AND s IS NOT NULL AND d IS NULL THEN 'external' WHEN s IS NULL OR d IS NULL THEN 'dangling' WHEN sf[-3:] <> df[-3:] AND (relation <> 'calls' OR confidence = 'INFERRED') THEN 'crossed' WHEN relation = 'imports' AND s = d THEN 'loop' ELSE 'found' END AS fate FROM j)"""


def extraction_of(t: Tables) -> X.Built:
    """Parts and suppliers as nodes under the names of two extractors, lines as edges, orders as hyperedges."""
    put = lambda a, c, z="": F.concat(F.lit(a), F.col(c), F.lit(z))
    supplier = t.supplier.withColumn("path", F.concat(put("src/n", "s_nationkey"), F.when(F.col("s_nationkey") % 5 == 0, ".ts").otherwise(".py")))
    parts = t.part.select(put("P", "p_partkey").alias("id"), F.col("p_name").alias("label"), F.lit("").alias("name"), put("src/p", "p_size", ".py").alias("path"), F.lit("ast").alias("origin"))
    named = supplier.select(put("S", "s_suppkey").alias("id"), F.lit(None).cast("string").alias("label"), F.col("s_name").alias("name"), "path", F.lit("ast").alias("origin"))
    again = supplier.where("s_nationkey < 12").select(put("ghost_", "s_suppkey").alias("id"), F.lit(" ").alias("label"), F.col("s_name").alias("name"), "path", F.lit(None).cast("string").alias("origin"))
    line = F.col("l_linenumber") % 4
    ends = F.when(line == 1, put("Ghost-", "l_suppkey")).when(line == 2, F.concat(F.lit("ext."), F.col("l_suppkey") % 7)).when(line == 3, put("P", "l_partkey")).otherwise(put("S", "l_suppkey"))
    relation = F.when(F.col("l_returnflag") == "R", "imports").when(F.col("l_returnflag") == "A", "calls").otherwise("references")
    confidence = F.when(F.col("l_linestatus") == "O", "EXTRACTED").otherwise(F.col("l_tax").cast("string"))
    weight = F.when(F.col("l_discount") < 0.03, "-1").otherwise(F.col("l_discount").cast("string"))
    edges = t.lineitem.select(put("p", "l_partkey").alias("from"), ends.alias("target"), relation.alias("type"), confidence.alias("confidence"), weight.alias("weight"))
    listed = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(put("p", "l_partkey")).alias("m"), F.collect_list(put("none_", "l_suppkey")).alias("x"))
    both = listed.select("id", F.when(F.col("id") % 2 == 0, F.when(F.col("id") % 10 == 0, F.col("x")).otherwise(F.concat("m", "x"))).alias("nodes"), F.col("m").alias("members"))
    return X.build(parts.union(named).union(again), edges, both)


@query(f"""WITH {_FOUND}, w AS (SELECT s AS src, coalesce(d, dst) AS dst, max(struct_pack(specific := relation <> 'references', relation := relation, trust := CASE confidence WHEN 'EXTRACTED' THEN 3 ELSE 2 END, score := coalesce(score, -1.0), weight := weight)) AS e FROM u WHERE fate IN ('found', 'external') GROUP BY 1, 2)
SELECT src, dst, e.relation AS relation, CASE e.trust WHEN 3 THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence, round(e.weight, 6) AS weight FROM w""")
def graph_build_edges(t: Tables) -> DataFrame:
    """One edge a pair of nodes that were resolved, external ones included."""
    return extraction_of(t).edges.select("src", "dst", "relation", "confidence", F.round("weight", 6).alias("weight"))


@query(f"""WITH {_FOUND}, o AS (SELECT DISTINCT l_orderkey AS h, 'p' || l_partkey AS ref FROM lineitem WHERE l_orderkey % 10 <> 0), o2 AS (SELECT DISTINCT l_orderkey AS h, l_suppkey FROM lineitem WHERE l_orderkey % 2 = 0)
SELECT 'edges ' || fate AS kind, count(*) AS n FROM u GROUP BY 1 UNION ALL SELECT 'nodes merged', count(*) FROM m UNION ALL SELECT 'nodes kept', count(*) FROM n UNION ALL SELECT 'nodes external', count(DISTINCT dst) FROM u WHERE fate = 'external'
UNION ALL SELECT 'members kept', count(*) FROM o UNION ALL SELECT 'members lost', count(*) FROM o2 UNION ALL SELECT 'hyperedges kept', count(DISTINCT h) FROM o UNION ALL SELECT 'hyperedges lost', count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey % 10 = 0""")
def graph_build_report(t: Tables) -> DataFrame:
    """What became of everything that was found."""
    return extraction_of(t).report
