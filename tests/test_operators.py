import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.functions import similarity
from weftgraph.functions.similarity import euclidean
from weftgraph.operators import anomaly, clustering, evaluation, ged, graph, mining, pairs
from weftgraph.plans import programs
from weftgraph.sources import delimited, gml, sinks

BASKETS = [(1, "Bread Milk Diapers"), (2, "Bread Diapers Beer Eggs"), (3, "Milk Diapers Beer Cola"), (4, "Bread Milk Diapers Beer"), (5, "Bread Milk Diapers Cola")]


def test_generic_graph(spark):
    v = spark.createDataFrame([("g", i, str(i)) for i in range(4)], "graph string, id int, name string")
    e = graph.edge_set(spark.createDataFrame([("g", a, b) for a, b in ((0, 1), (0, 2), (2, 3), (1, 2), (1, 3), (0, 1))], "graph string, src int, dst int"))
    assert [(r.out_degree, r.in_degree) for r in graph.degrees(v, e).orderBy("id").collect()] == [(2, 0), (2, 1), (1, 2), (0, 2)]
    assert [tuple(r)[1:] for r in graph.sizes(v, e).collect()] == [(4, 5, False)]
    keys = spark.createDataFrame([("g", 0, 3), ("g", 2, 3)], "graph string, src int, dst int")
    assert {(r.src, r.found) for r in graph.lookup_edges(e, keys).collect()} == {(0, False), (2, True)}
    v2, e2 = graph.remove_vertices(v, e, spark.createDataFrame([("g", 1)], "graph string, id int"))
    assert v2.count() == 3 and sorted((r.src, r.dst) for r in e2.collect()) == [(0, 2), (2, 3)]
    assert graph.upsert(v, spark.createDataFrame([("g", 0, "new")], v.schema)).where("id = 0").first().name == "new"
    assert graph.lookup_vertices(v, spark.createDataFrame([("g", 9)], "graph string, id int")).first().name is None


def test_call_graph_and_gml(spark, tmp_path):
    f = spark.createDataFrame([("b", 0, "F1", ["aliasF1"], ["external1"]), ("b", 1, "F2", [], ["F1"]), ("b", 2, "F3", [], ["aliasF1", "external2"]), ("b", 3, "F4", [], ["external1"])], "binary string, fn_id int, name string, aliases array<string>, called array<string>")
    v, e = graph.call_graph(f, F.array(F.lit(1), F.lit(2)).cast("array<bigint>"))
    assert [(r.id, r.name) for r in v.orderBy("id").collect()][4:] == [(4, "external1"), (5, "external2")]
    edges = sorted((r.src, r.dst) for r in e.collect())
    assert edges == [(0, 4), (1, 0), (2, 0), (2, 5), (3, 4)]
    doc = gml.documents(v, e).first()
    rows = list(gml.parse(doc.text))
    assert sorted(r[7:] for r in rows if r[1] == "edge") == edges
    assert sorted((r[2], r[3], r[4], r[5]) for r in rows if r[1] == "vertex") == sorted((r.id, r.name, r.type, None if r.features is None else [str(x) for x in r.features]) for r in v.collect())
    (tmp_path / "b.gml").write_text(doc.text)
    back = gml.read(spark, str(tmp_path))
    assert back.where("kind = 'edge'").count() == 5 and back.where("kind = 'vertex'").select(gml.decoded(F.col("features"), "long").alias("f")).where("f is not null").first().f == [1, 2]
    gml.write(gml.documents(v, e), str(tmp_path / "out"))
    assert "vsize 6" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    with pytest.raises(Exception, match="no name"):
        gml.documents(v.withColumn("graph", F.lit(None).cast("string")), e).collect()


def test_feature_codecs(spark):
    p = spark.createDataFrame([([3, 5, 9928],), ([],)], "p array<int>")
    w = p.select("p", gml.words_of(F.col("p"), 160).alias("w"))
    assert [r.x for r in w.select(gml.positions_of(F.col("w")).alias("x")).collect()] == [[3, 5, 9928], []]
    text = 'graph [\n node [\n id 1\n label "x y"\n type "Internal"\n features [\n val "1.5"\n val "NaN"\n val "null"\n val "7"\n ]\n ]\n node [\n id 2\n ]\n edge [\n source 1\n ]\n edge [\n source 1\n target 1\n ]\n]\n'
    rows = list(gml.parse(text, "double"))
    assert [r[1] for r in rows] == ["vertex", "edge"] and rows[0][5] == ["1.5", "NaN", "null"]
    code = spark.createDataFrame([(["8B:mov", "0F 95:setnz"],)], "f array<string>").select(gml.decoded(F.col("f"), "instructions").alias("i"))
    assert [tuple(x) for x in code.first().i] == [("8B", "mov"), ("0F 95", "setnz")]
    assert code.select(gml.encoded(F.col("i"), "instructions").alias("s")).first().s == ["8B:mov", "0F 95:setnz"]


def test_apriori_and_rules(spark):
    tx = spark.createDataFrame([(i, x.split()) for i, x in BASKETS], "tx_id int, items array<string>")
    assert {tuple(r.itemset) for r in mining.level_one(tx).collect()} == {("Bread",), ("Beer",), ("Cola",), ("Milk",), ("Eggs",), ("Diapers",)}
    levels = mining.apriori_levels(tx, 0.6)
    assert levels[1].count() == 4 and [(r.itemset, r.support) for r in levels[2].collect()] == [(["Bread", "Diapers", "Milk"], 3)]
    got = {(tuple(r.antecedent), tuple(r.consequent)): r.confidence for r in mining.rules(levels, 0.0).collect()}
    assert got[("Diapers",), ("Bread", "Milk")] == pytest.approx(3 / 5) and len(got) == 3
    assert len(mining.rules(levels, 0.0, least=1).collect()) == 6
    some = mining.rules(levels, 0.0, least=1, deepest=False)
    assert some.count() == 6 + 2 * 4


def test_sequences(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    a, b = F.array(*map(F.lit, (0, 4))), F.array(*map(F.lit, (1, 2, 4)))
    assert [one(mining.s_step(a, b, g)) for g in (0, 1, 2, 3)] == [[1], [1, 2], [1, 2], [1, 2, 4]]
    assert one(mining.s_step(F.array().cast("array<int>"), b)) == [] and one(mining.s_step(F.array(F.lit(0)), b)) == [1, 2, 4]
    assert one(mining.i_step(b, F.array(F.lit(2)))) == [2]
    seq = F.array(F.array(F.lit("a")), F.array(F.lit("b")))
    assert one(mining.extend_sequence(seq, F.lit("c"))) == [["a"], ["b"], ["c"]] and one(mining.extend_itemset(seq, F.lit("a"))) == [["a"], ["a", "b"]]
    assert one(mining.sequence_name(seq)) == "a>b" and one(mining.sequence_length(seq)) == 2
    rows = spark.createDataFrame([("f", i, x) for i, x in enumerate("abcab")], "k string, i int, x string")
    got = {tuple(s[0] for s in r.sequence): r.support for r in mining.spam(mining.positions(rows, "k", "i", "x"), "k", "x", 0.2, most=2).collect()}
    want = {}
    for p in "abc":
        for q in "abc":
            n = sum(1 for j, y in enumerate("abcab") if y == q and "abcab".find(p) < j)
            if n >= 1:
                want[p, q] = n / 5
    assert got == pytest.approx(want)


def test_clusters(spark):
    rng = np.random.default_rng(0)
    centres = [(0, 0), (10, 0), (0, 10)]
    pts = [(i * 20 + k, [float(x) for x in rng.normal(c, 0.3)]) for i, c in enumerate(centres) for k in range(20)]
    df = spark.createDataFrame(pts, "id long, v array<double>")
    truth = lambda i: i // 20

    def pure(rows):
        return len({(truth(r.id), r.cluster) for r in rows}) == 3 and len({r.cluster for r in rows}) == 3

    a, c = clustering.kmeans(df, 3, start=[(i, list(pts[i * 20][1])) for i in range(3)])
    assert pure(a.collect()) and len(c) == 3
    assert len(clustering.seeds_plus(df, 3, 1)) == 3
    cuts = []
    assert pure(clustering.bisecting(df, 3, 2, cuts=cuts).collect()) and len(cuts) == 2
    x = df.select("id", "v").join(df.select(F.col("id").alias("other"), F.col("v").alias("w")), F.col("id") != F.col("other")).select("id", "other", euclidean(F.col("v"), F.col("w")).alias("d"))
    assert pure(clustering.kmedoids(x, df.select("id"), 3, start=[0, 20, 40])[0].collect())
    for link in clustering.LINKS + clustering.CENTRES:
        shifted = df.withColumn("v", F.transform("v", lambda z: z + 1.0))
        got, trace = clustering.agglomerative(shifted, 3, link)
        assert len(trace) == 57 and (link in clustering.CENTRES or pure(got.collect()))
    with pytest.raises(ValueError):
        clustering.agglomerative(df, 3, "other")
    flat = clustering.min_max(spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "a double, b double"), ["a", "b"]).orderBy("a").collect()
    assert [r.a for r in flat] == [0, 1] and all(math.isnan(r.b) for r in flat)


def test_evaluation_and_anomaly(spark):
    a = spark.createDataFrame([(0, 0, "x"), (1, 0, "x"), (2, 0, "y"), (3, 1, "y")], "id long, cluster int, label string")
    assert evaluation.entropy(a).first()[0] == pytest.approx(0.75 * -(2 / 3 * math.log(2 / 3) + 1 / 3 * math.log(1 / 3)))
    assert evaluation.f_measure(a).first()[0] == pytest.approx((2 * 1 + 2 * (2 * 0.5 / 1.5)) / 4)
    r = evaluation.pair_statistics(a).first()
    assert r.rand == pytest.approx(4 / 6) and r.rand_index == pytest.approx(3 / 6)
    p = evaluation.by_cluster(a)
    assert evaluation.accuracy(p).first()[0] == pytest.approx(3 / 4) and math.isnan(evaluation.accuracy(p.where("false")).first()[0])
    assert {tuple(r) for r in evaluation.confusion(p, ["x", "y", "z"]).collect()} == {("x", 2, 0, 0), ("y", 1, 1, 0), ("z", 0, 0, 0)}
    s = spark.createDataFrame([(0, 0.1, "n"), (1, 0.2, "p"), (2, 0.3, "n"), (3, 0.4, "n")], "id long, score double, label string")
    assert anomaly.roc_auc(s, "label", "p").first()[0] == pytest.approx(2 / 3)
    d = spark.createDataFrame([(0, 1, 1.0), (0, 2, 5.0), (1, 2, 4.0)], "a long, b long, d double")
    sym = pairs.symmetric(d, "a", "b", "d")
    assert {r.id: r.score for r in anomaly.density_ratio(sym, 1).collect()} == pytest.approx({0: 1, 1: 1, 2: 4})
    assert {(r.id, r.other) for r in pairs.nearest(sym, 1).collect()} == {(0, 1), (1, 0), (2, 1)}
    labels = spark.createDataFrame([(0, "x"), (1, "x"), (2, "y")], "id long, label string")
    assert {r.id: r.predicted for r in evaluation.knn(sym, labels, 1).collect()} == {0: "x", 1: "x", 2: "x"}


def test_mapping_cost_and_annealing(spark):
    m = spark.createDataFrame([("p", 1, 1, 0.0), ("p", 2, 2, 1.0), ("p", 3, 3, 1.0), ("p", None, 4, 0.0)], "k string, v1 int, v2 int, relabel double")
    e = lambda xs: spark.createDataFrame([("p", a, b) for a, b in xs], "k string, src int, dst int")
    r = ged.mapping_cost(m, e([(1, 2), (1, 3), (2, 3)]), e([(1, 2), (2, 3), (1, 4)]), ["k"]).first()
    assert (r.vertex_cost, r.edge_cost, r.relabel_cost) == (1, 2, 2) and r.cost == pytest.approx(1 / 4 + 2 / 6 + 2 / 4)
    rng = np.random.default_rng(1)
    names1, names2 = {1: "A", 2: "A", 3: "B"}, {1: "A", 2: "C", 3: "A", 4: "B"}
    s = ged.State([1, 2, 3], [1, 2, 3, 4], {(1, 2), (1, 3), (2, 3)}, {(1, 2), (2, 3), (1, 4)}, lambda x, y: float(names1[x] != names2[y]), rng)
    s.to = np.arange(4)
    assert s.cost() == pytest.approx(1 / 4 + 2 / 6 + 2 / 4)
    for _ in range(200):
        i, j = rng.choice(4, 2, replace=False)
        before = s.cost()
        assert s.swap(int(i), int(j)) == pytest.approx(s.cost() - before)
    v = spark.createDataFrame([(g, i, "External", x, None) for g in ("a", "b") for i, x in enumerate("PQR")], "graph string, id int, type string, name string, features array<long>")
    ed = spark.createDataFrame([(g, 0, 1) for g in ("a", "b")], "graph string, src int, dst int")
    assert ged.all_pairs(ged.packed(v, ed), lambda x, y: 0.0).first().d == pytest.approx(0)
    assert sinks.distance_csv(ged.one_pair(ged.packed(v, ed), "a", "b", lambda x, y: 0.0)).first().GED == "0.000000"


def test_all_distances_in_blocks(spark):
    rng = np.random.default_rng(3)
    pts = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(70)]
    df = spark.createDataFrame(pts, "id long, v array<double>")
    want = {(i, j): math.dist(v, w) for i, v in pts for j, w in pts if i != j}
    for block in (16, 512):
        got = {(r.id, r.other): r.d for r in pairs.all_distances(df, block).collect()}
        assert got == pytest.approx(want)
        assert {(r.id, r.other) for r in pairs.all_distances(df, block, both=False).collect()} == {k for k in want if k[0] < k[1]}


def test_reduction_matches_greedily(spark):
    c = spark.createDataFrame([("k", 1, 1, 0.9), ("k", 1, 2, 0.95), ("k", 2, 2, 0.99), ("k", 2, 1, 0.1)], "k string, a int, b int, s double")
    assert {(r.a, r.b) for r in pairs.greedy_match(c, ["k"], "a", "b", "s").collect()} == {(2, 2), (1, 1)}
    assert {(r.a, r.b) for r in pairs.mutual_best(c, ["k"], "a", "b", "s").collect()} == {(2, 2)}


def test_delimited_sources_and_sinks(spark, tmp_path):
    attrs = delimited.attributes(["a: continuous", "", "b: x y", "id: ID"])
    assert [(x.name, x.kind, x.values) for x in attrs] == [("a", "continuous", ()), ("b", "discrete", ("x", "y")), ("id", "ID", ())]
    rows = spark.createDataFrame([("a,b,id,class",), ("1.5 x|7,c1",), ("2,y",), ("3 , y , 8 , c2",)], "value string")
    got = delimited.instances(rows, attrs, header=True).collect()
    assert [(r.a, r.b, r.id, r.label) for r in got] == [(1.5, "x", "7", "c1"), (3.0, "y", "8", "c2")]
    (tmp_path / "l.csv").write_text('"Id","Class"\n"a",1\n"b",2\n"a",3\nbad\n')
    assert {(r.id, r["class"]) for r in delimited.labels(spark, str(tmp_path / "l.csv")).collect()} == {("a", "3"), ("b", "2")}
    (tmp_path / "d.csv").write_text("graph1,graph2,GED\na,b,0.5\n")
    assert [tuple(r) for r in delimited.distances(spark, str(tmp_path / "d.csv")).collect()] == [("a", "b", 0.5)]
    (tmp_path / "v.csv").write_text('"0F 95-8B-",0\nmov-,1\n')
    assert [tuple(r) for r in delimited.vocabulary(spark, str(tmp_path / "v.csv")).collect()] == [("0F 95-8B-", 0), ("mov-", 1)]
    vectors = spark.createDataFrame([("g1", "b", 2), ("g1", "a", 1), ("g2", "b", 5)], "graph string, entry string, freq int")
    vocab = spark.createDataFrame([("a", 0), ("b", 1)], "entry string, idx int")
    head, lines = sinks.arff_lines(vectors, "graph", "entry", "freq", vocab, spark.createDataFrame([("g1", "c")], "id string, class string"))
    assert head[-3:] == ["@ATTRIBUTE class {c}", "", "@DATA"] and {r.line for r in lines.collect()} == {"g1,1,2,c", "g2,0,5,null"}
    sinks.write_arff(head, lines, "graph", str(tmp_path / "arff"))
    assert sinks.wide(vectors, "graph", "entry", "freq", ["a", "b"]).where("graph = 'g2'").first().a == 0


def test_entries_of_a_folder(spark, tmp_path):
    """A table that is a folder of files counts as one entry, under the folder's name."""
    (tmp_path / "a.parquet").write_bytes(b"xx")
    (tmp_path / "b.parquet").mkdir()
    for i in (0, 1):
        (tmp_path / "b.parquet" / f"part-{i}.parquet").write_bytes(b"x" * (3 - i))
    (tmp_path / "c.txt").write_bytes(b"x")
    every = {("a.parquet", 2), ("b.parquet", 2), ("c.txt", 1)}
    assert {tuple(r) for r in delimited.entries(spark, str(tmp_path)).collect()} == every
    assert {tuple(r) for r in delimited.entries(spark, f"{tmp_path}/", ".parquet").collect()} == every - {("c.txt", 1)}


def plainly_merged(d, k, link):
    """The closest two clusters merge, the lowest places first on a tie, with the whole matrix searched each time."""
    d, groups = d.copy(), {i: [i] for i in range(len(d))}
    np.fill_diagonal(d, np.inf)
    while len(groups) > k:
        i, j = (int(x) for x in np.unravel_index(d.argmin(), d.shape))
        a, b = len(groups[i]), len(groups[j])
        row = {"single": np.minimum(d[i], d[j]), "complete": np.maximum(d[i], d[j]), "average": (a * d[i] + b * d[j]) / (a + b)}[link]
        d[i], d[:, i] = row, row
        d[j], d[:, j], d[i, i] = np.inf, np.inf, np.inf
        groups[i] += groups.pop(j)
    return [sorted(x) for x in groups.values()]


def test_merging_with_the_upper_half(spark):
    """Also with many ties, and with more points than the matrix in memory is for."""
    rng = np.random.default_rng(5)
    for link in clustering.LINKS:
        for v in (rng.normal(size=(60, 3)), rng.integers(0, 4, (60, 2)).astype(float)):
            d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
            for most in (100, 10):
                half = clustering.upper_half(60, most)
                half[:] = d[np.triu_indices(60, 1)]
                assert clustering.merge_linked(half, 60, 4, link)[0] == plainly_merged(d, 4, link)
    df = spark.createDataFrame([(i, [float(i // 4 * 10 + i % 4)]) for i in range(12)], "id long, v array<double>")
    got = clustering.agglomerative(df, 3, "average", most=5)[0]
    assert sorted(tuple(r) for r in got.collect()) == [(i, i // 4) for i in range(12)]


def test_kmeans_counts_its_updates(spark):
    """Centroids that are still moving after ``most`` updates are those that the assignment goes by."""
    df = spark.createDataFrame([(i, [float(i)]) for i in range(20)], "id long, v array<double>")
    for distance in (euclidean, lambda a, b: euclidean(a, b)):
        a, c = clustering.kmeans(df, 2, distance, start=[(0, [0.0]), (1, [1.0])], most=1)
        assert c == [(0, [0.0]), (1, [10.0])]
        assert {r.id for r in a.where("cluster = 0").collect()} == set(range(6))
        assert [x[1] for x in clustering.kmeans(df, 2, distance, start=[(0, [0.0]), (1, [1.0])])[1]] == [[4.5], [14.5]]


def test_nearest_points(spark):
    """The same as the nearest of all distances, with equal points in plenty, and with fewer points than neighbours."""
    rng = np.random.default_rng(4)
    pts = [(i, [float(x) for x in (np.zeros(3) if i < 30 else rng.integers(0, 3, 3) if i < 80 else rng.normal(size=3))]) for i in range(120)]
    for rows in (pts, pts[:3], pts[:1]):
        df = spark.createDataFrame(rows, "id long, v array<double>")
        want = {tuple(r) for r in pairs.nearest(pairs.all_distances(df).withColumn("d", F.round("d", 9)), 4).collect()}
        for block, chunk in ((50, 7), (8192, 256)):
            assert {tuple(r) for r in pairs.nearest_points(df, 4, block, chunk).collect()} == want


def test_token_texts(spark):
    """Tokens of any number are characters of their own, so a text's edit distance counts tokens."""
    rows = [(0, ["a", "b", "c"]), (1, ["a", "c"]), (2, []), (3, None), (4, [f"t{i}" for i in range(60_000)]), (5, [f"t{i}" for i in range(60_000) if i % 2000])]
    got = pairs.token_texts(spark.createDataFrame(rows, "id int, tokens array<string>"), "tokens")
    texts = {r.id: r.text for r in got.collect()}
    assert len(texts[0]) == 3 and texts[1] == texts[0][0] + texts[0][2] and texts[2] == "" and texts[3] is None
    assert len(set(texts[4])) == 60_000 and set(texts[5]) < set(texts[4]) and len(texts[5]) == 59_970


def test_comparison_without_a_limit(spark):
    """Graphs of more functions than the limit stay in if there is none."""
    v = spark.createDataFrame([("a", "Internal", [1], [("x",), ("y",)]), ("a", "Internal", [2], [("x",)]), ("b", "Internal", [1], [("z",), ("y",)])], "graph string, type string, features array<int>, instructions array<struct<asm: string>>")
    labels = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, class string")
    got = {most: sorted(tuple(r) for r in programs.edit_versus_sketch(v, labels, most=most).collect()) for most in (None, 1)}
    assert got == {None: [("1", "2", 0.0, 0.0), ("1", "2", 0.5, 1.0), ("2", "1", 0.0, 0.0), ("2", "1", 0.5, 1.0)], 1: []}

def test_bisecting_by_a_number_of_updates(spark, monkeypatch):
    """Each split takes as many updates as it is told, all its trials in the same scans."""
    df = spark.createDataFrame([(i, [float(i)]) for i in range(20)], "id long, v array<double>")
    asked = []
    monkeypatch.setattr(clustering, "_lloyd", lambda p, starts, d, most, f=clustering._lloyd: asked.append((len(starts), most)) or f(p, starts, d, most))
    assert {r.cluster for r in clustering.bisecting(df, 3, 4, most=7).collect()} == {0, 1, 2} and asked == [(4, 7), (4, 7)]


def test_kmedoids_of_points(spark):
    """The medoids and clusters of a plain run, in blocks of any size; of equal medoids the first has the points, and the other's cluster ends."""
    rng = np.random.default_rng(5)
    pts = {i: [float(x) for x in (np.ones(2) if i % 10 == 0 else rng.normal(size=2) + 3 * (i % 3))] for i in range(90)}
    d = {(i, j): round(math.dist(v, w), 9) for i, v in pts.items() for j, w in pts.items()}
    start = sorted(pts, key=lambda i: hashlib.md5(f"0:{i}".encode()).hexdigest())
    for k, twice in ((4, False), (90, True)):
        medoids = dict(enumerate(start[:k]))
        for _ in range(3):
            of = {i: min((d[i, m], c) for c, m in medoids.items())[1] for i in pts}
            held = {c: [i for i in pts if of[i] == c] for c in medoids}
            medoids = {c: min((round(sum(d[i, j] for j in xs), 6), i) for i in xs)[1] for c, xs in held.items() if xs}
        assert twice == (len(medoids) < k)
        want = {(i, min((d[i, m], c) for c, m in medoids.items())[1]) for i in pts}
        for block in (25, 4096):
            a, found = clustering.kmedoids_of_points(spark.createDataFrame([*pts.items()], "id long, v array<double>"), k, most=3, block=block)
            assert found == medoids and {(r.id, r.cluster) for r in a.collect()} == want


def test_nearest_points_by_text(spark):
    """Ties at the file's digits go to the first id as text, so 10 comes before 9."""
    rng = np.random.default_rng(6)
    pts = [(i, [float(x) for x in (np.zeros(2) if i < 40 else rng.integers(0, 3, 2) + 2e-7 * rng.random(2))]) for i in range(120)]
    df = spark.createDataFrame(pts, "id long, v array<double>")
    all_ = pairs.all_distances(df).select(F.col("id").cast("string").alias("id"), F.col("other").cast("string").alias("other"), F.round("d", 6).alias("d"))
    want = {tuple(r) for r in pairs.nearest(all_, 4).collect()}
    for block, chunk in ((50, 7), (8192, 256)):
        assert {tuple(r) for r in pairs.nearest_points(df, 4, block, chunk, digits=6, text=True).collect()} == want


def test_knn_files_grow_with_points(spark):
    """The distance file of the nearest has at most k rows a point, not a row a pair."""
    from weftgraph import file_queries

    d = "/root/testdata/sf0.001"
    n = file_queries.unit_vectors(spark, d).count()
    assert n < delimited.distances(spark, file_queries.near_distance_files(spark, d, 5)).count() <= 5 * n < n * (n - 1) // 2


def test_kernel_pairs(spark):
    """Each pair of a group once, the smaller id first, in blocks of any size; groups of one item and of none; rows of other lengths are refused."""
    rng = np.random.default_rng(7)
    pts = [(i, f"g{min(i % 4, i % 3)}" if i < 100 else None if i < 103 else "alone", [float(x) for x in rng.normal(size=3)]) for i in range(104)]
    df = spark.createDataFrame(pts, "id int, g string, v array<double>")

    def kernel(one, other, turned):
        return {"dot": similarity.each_sum(one[0], other[0], np.multiply)[0], "first": np.where(turned, other[0][:, 0][None], one[0][:, 0][:, None])}

    out = {"dot": pa.float64(), "first": pa.float64()}
    for by in ("g", None):
        want = {(i, j): (v[0] * w[0] + v[1] * w[1] + v[2] * w[2], v[0]) for i, g, v in pts for j, h, w in pts if i < j and (by is None or g == h is not None)}
        for block, chunk in ((16, 5), (2048, 64)):
            rows = pairs.kernel_pairs(df, "id", ["v"], kernel, out, by, block, chunk).collect()
            assert len(rows) == len(want) and {(r.a, r.b): (r.dot, r["first"]) for r in rows} == want
    uneven = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "id int, v array<double>")
    with pytest.raises(Exception, match="differ in length"):
        pairs.kernel_pairs(uneven, "id", ["v"], kernel, out).collect()


def test_each_matching():
    """The numpy forms agree with the column functions' meanings, zero vectors and negative cosines included."""
    x = np.array([[1.0, 0.0], [0.0, 0.0], [-1.0, 1.0]])
    c = similarity.each_cosine(x, x)
    assert c.tolist() == [[1.0, 0.0, -1 / math.sqrt(2)], [0.0, 0.0, 0.0], [-1 / math.sqrt(2), 0.0, pytest.approx(1.0)]]
    assert similarity.each_matching("cosine", 0.25)(c).tolist() == [[False, True, False], [True, True, True], [False, True, False]]
    assert similarity.each_matching("cosine", 0.25, strict=True)(c).tolist() == [[True, False, False], [False, False, False], [False, False, True]]


def test_near_match(spark):
    """The same pairs as from a table of all pairs, with equal numbers, equal distances, nulls, and keys on one side only."""
    rng = np.random.default_rng(8)
    number = lambda: None if rng.random() < 0.08 else float(rng.integers(0, 40)) / 10 + (1e16 if rng.random() < 0.1 else 0)
    for n, m in ((30, 12), (9, 40), (1, 1)):
        a = [(f"k{k}", 1000 * k + i, number()) for k in range(6) for i in rng.permutation(n).tolist()] + [("left", 1, 1.0), (None, 2, 1.0)]
        b = [(f"k{k}", 1000 * k + i, number()) for k in range(6) for i in rng.permutation(m).tolist()] + [("right", 1, 1.0), (None, 2, 1.0)]
        x, y = spark.createDataFrame(a, "k string, a long, x double"), spark.createDataFrame(b, "k string, b long, y double")
        all_ = x.join(y, "k").select("k", "a", "b", (-F.abs(F.col("x") - F.col("y"))).alias("s"))
        for plain, mutual in ((pairs.greedy_match, False), (pairs.mutual_best, True)):
            want = sorted((r.k, r.a, r.b, str(r.s)) for r in plain(all_, ["k"], "a", "b", "s").collect())
            got = sorted((r.k, r.a, r.b, str(r.s)) for r in pairs.near_match(x, y, "k", "a", "x", "b", "y", "s", mutual).collect())
            assert got == want


def test_greedy_classes(spark):
    """The same matches as from the pairs of all members, with equal scores in plenty."""
    rng = np.random.default_rng(9)
    rows = []
    for key in ("p", "q"):
        a, b = (np.array_split(rng.permutation(30 + 7 * i), [1, 4, 9, 20]) for i in (0, 1))
        rows += [(key, sorted(x.tolist()), sorted(y.tolist()), float(rng.integers(1, 4)) / 4) for x in a for y in b if rng.random() < 0.8]
    c = spark.createDataFrame(rows, "k string, a array<int>, b array<int>, s double")
    each = c.select("k", F.explode("a").alias("a"), "b", "s").select("k", "a", F.explode("b").alias("b"), "s")
    want = {tuple(r) for r in pairs.greedy_match(each, ["k"], "a", "b", "s").collect()}
    assert {tuple(r) for r in pairs.greedy_classes(c, ["k"], "a", "b", "s").collect()} == want


def test_edges_of_state(spark):
    """A mapping's costs are the same from numbers as from a set of edges, and after swaps those of a mapping that is counted whole; edges to ids that a graph lacks, and graphs without edges, too."""
    rng = np.random.default_rng(10)
    one, two = ({(int(a), int(b)) for a, b in rng.integers(0, n, (60, 2))} for n in (12, 16))
    rows = lambda x: np.array(sorted(x), "<i8").reshape(-1, 2).T
    ids1, ids2 = [int(x) for x in rng.permutation(10)], [int(x) for x in rng.permutation(16)]
    for e1, e2 in ((one, two), (one, set())):
        plain, packed = (ged.State(ids1, ids2, *e, lambda x, y: 0.5, np.random.default_rng(1)) for e in ((e1, e2), (rows(e1), rows(e2))))
        assert (plain.a == packed.a).all() and (plain.b == packed.b).all()
        for i, j in ((0, 1), (3, 15), (12, 2)):
            before = packed.cost()
            assert packed.swap(i, j) == pytest.approx(packed.cost() - before)
    v = spark.createDataFrame([("g", 1, "Internal", "a", [1]), ("h", 1, "Internal", "a", [1])], "graph string, id int, type string, name string, features array<int>")
    e = spark.createDataFrame([("g", 1, 2), ("g", 1, 1), ("g", 0, 5)], "graph string, src int, dst int")
    es = {r.graph: r.es for r in ged.packed(v, e).collect()}
    assert ged.unpacked(es["g"]).tolist() == [[0, 1, 1], [5, 1, 2]] and es["h"] is None and ged.unpacked(None).shape == (2, 0)


def test_reduced_pairs_join_no_edges(spark):
    kinds = "graph string, id int, type string, name string, features array<bigint>"
    v = spark.createDataFrame([("a", 0, "Internal", "f", [1, 2]), ("a", 1, "External", "x", None), ("a", 2, "External", "y", None), ("b", 0, "Internal", "g", [1, 2]), ("b", 1, "External", "x", None), ("c", 0, "Internal", "h", [1, 2])], kinds)
    e = spark.createDataFrame([("a", 1, 2), ("a", 0, 1), ("b", 0, 1)], "graph string, src int, dst int").repartition(3)
    df = programs.all_pair_similarity(v, e, threshold=0.5)
    assert "dst" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.graph1, r.graph2): r.d for r in df.collect()}
    assert got.pop(("a", "b")) in (1.5, 2.0) and got == {("a", "c"): 2.0, ("b", "c"): 1.0}  # an edge and a vertex of a are left beside a vertex of b
    assert {r.graph: ged.unpacked(r.es).tolist() for r in ged.packed(v, e).collect()} == {"a": [[0, 1], [1, 2]], "b": [[0], [1]], "c": [[], []]}


def test_gml_in_pieces(spark, tmp_path):
    v = spark.createDataFrame([("g", i, "External" if i % 3 else "Internal", f"n]{i} [", None if i % 3 else [i, -i]) for i in range(50)] + [("h", 0, "Internal", "edge [", [])], "graph string, id int, type string, name string, features array<bigint>")
    e = spark.createDataFrame([("g", s, d) for s in range(50) for d in range(50) if s != d], "graph string, src int, dst int")
    gml.write_graphs(v, e, str(tmp_path / "out"))
    docs = {r.graph: r.text for r in gml.documents(v, e).collect()}
    assert {g: "".join(f.read_text() for f in (tmp_path / "out" / f"graph={g}").glob("*.txt")) for g in docs} == docs
    want = sorted(map(str, (r for text in docs.values() for r in gml.parse(text))))
    assert len(want) == 51 + 50 * 49
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # a file is read in many parts
    try:
        back = gml.read(spark, str(tmp_path / "out"), suffix=".txt")
        assert "wholetext" not in back._jdf.queryExecution().toString().lower() and sorted(str(tuple(r)) for r in back.collect()) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    odd = 'graph [\n\tedge [\n\t\tsource 1\n\t\ttarget 2\n\t]\n\tnode [\n\t\tid 1\n\tedge [\n\t\tsource 3\n\t\ttarget 4\n\t]\n\tedge [\n\t\tsource 5\n\t]\n name "q"\n edge [\n source 7 \n target 8 \n ] \n]\ngraph [\n'
    assert list(gml.parse(odd)) == [("q", "edge", None, None, None, None, None, 1, 2), ("q", "edge", None, None, None, None, None, 7, 8)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "bare.gml").write_text("graph [\n edge [\n source 1\n target 2\n ]\n]\n")
    assert [r.graph for r in gml.read(spark, str(tmp_path / "in")).collect()] == ["bare"]


def test_lookup_of_all_pairs(spark):
    df = spark.createDataFrame([(i, [math.sin(i * j + 1) for j in range(6)]) for i in range(40)], "id long, v array<double>")
    table = pairs.all_distances(df).select(F.col("id").alias("a"), F.col("other").alias("b"), F.round("d", 9).alias("d"))
    wanted = table.select("a", "b").union(df.select("id", "id"))
    got = pairs.lookup_all(df, 9, block=16)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.lookup_distance(wanted, table).collect()))
    assert "Join LeftOuter" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_distance_file_in_pieces(spark, tmp_path):
    """All pairs go through pieces of a distance file as through a whole one, in blocks of any size."""
    from weftgraph import file_queries

    rng = np.random.default_rng(8)
    pts = {i * 7: [float(x) for x in (np.ones(3) if i % 10 == 0 else 40 * rng.normal(size=3))] for i in range(60)}
    pts[3] = [math.nan] * 3
    pts[4] = [math.inf, 0.0, 0.0]
    pts[5] = [3e10, 0.1, 0.2]

    def read(path):
        return {(r.id1, r.id2): repr(r.d) for r in delimited.distances(spark, path).collect()}

    for some in (pts, {0: [1.0]}, {}):
        df = spark.createDataFrame([*some.items()], "id long, v array<double>")
        plain = pairs.all_distances(df, both=False, digits=6).select(F.col("id").alias("graph1"), F.col("other").alias("graph2"), "d")
        sinks.write_csv(sinks.distance_csv(plain), path := str(tmp_path / f"plain-{len(some)}"))
        want = read(path)
        assert len(want) == len(some) * (len(some) - 1) // 2
        for block, chunk in ((7, 3), (4096, 64)):
            got = pairs.distances_through(df, file_queries.through_distance_file, "id1 string, id2 string, d double", (6,), block, chunk).collect()
            assert len(got) == len(want) and {(r.id1, r.id2): repr(r.d) for r in got} == want
    with open(tmp_path / "piece.csv", "wb") as file:
        sinks.write_distance_piece(file, np.array([1, 2]), np.array([3, 40]), np.array([0.0, 12.5]))
    assert (tmp_path / "piece.csv").read_text() == "graph1,graph2,GED\n1,3,0.000000\n2,40,12.500000\n"
    assert read(str(tmp_path / "piece.csv")) == {("1", "3"): "0.0", ("2", "40"): "12.5"}


def test_distance_file_is_not_kept(spark):
    """What the query leaves in the shared folder are its points, not their pairs."""
    import os

    from weftgraph import file_queries
    from weftgraph.session import new_path, shared_dir

    folder = shared_dir(spark).removeprefix("file://") + "/weftgraph"
    spark.createDataFrame([(i, [float(i), 0.0], 0) for i in range(900)], "vec_id long, embedding array<float>, label int").write.parquet((d := new_path(spark, "small")) + "/embeddings.parquet")
    before = set(os.listdir(folder))
    assert file_queries.src16_snk6_distance_file(spark, d).count() == 900 * 899 // 2
    made = [os.path.join(at, f) for x in set(os.listdir(folder)) - before for at, _, files in os.walk(f"{folder}/{x}") for f in files]
    assert sum(map(os.path.getsize, made)) < 100_000


def test_clusters_from_files_grow_with_points(spark):
    """The distance file has a row for each point and medoid, and gives the classes that one of all pairs gives; of equal costs the first id as text is the medoid; a single vector is a cluster."""
    import os

    from weftgraph import file_queries
    from weftgraph.session import new_path, shared_dir

    folder = shared_dir(spark).removeprefix("file://") + "/weftgraph"
    rng = np.random.default_rng(9)
    for n in (600, 1):
        rows = [(i, [float(x) for x in 9 * (i % 8) + rng.integers(0, 4, 2)], i % 8 if i % 5 else 9) for i in range(n)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
        df.write.parquet((d := new_path(spark, "small")) + "/embeddings.parquet")
        before = set(os.listdir(folder))
        got = sorted(map(tuple, file_queries.e5_cl9_src16_clusters_from_files(spark, d).collect()))
        (file,) = (x for x in set(os.listdir(folder)) - before if x.startswith("distances-"))
        lines = delimited.distances(spark, f"file://{folder}/{file}").count()
        if n == 1:
            assert got == [("0", "9", "9")] and lines == 0
            continue
        all_ = pairs.all_distances(df.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")), both=False, digits=6)
        labels = df.select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("class"))
        whole = programs.cluster_by_distance(all_.select(F.col("id").cast("string").alias("id1"), F.col("other").cast("string").alias("id2"), "d"), labels, 8)[0]
        assert got == sorted(map(tuple, whole.collect())) and n <= lines <= 8 * n < n * (n - 1) // 2
    two = spark.createDataFrame([(9, [0.0]), (10, [1.0]), (7, [80.0]), (11, [82.0])], "id long, v array<double>")
    for text, want in ((True, {10, 11}), (False, {7, 9})):
        assert set(clustering.kmedoids_of_points(two, 2, seed=1, digits=6, text=text)[1].values()) == want


def test_edit_distances_of_blocks():
    """The distances of plain rows, for texts of no, one and more words of bits, in passes of any size."""
    rng = np.random.default_rng(10)
    for low, high, kinds in ((0, 6, 2), (60, 68, 3), (0, 300, 40)):
        x, y = ([rng.integers(0, kinds, rng.integers(low, high)) for _ in range(n)] for n in (9, 14))
        x[3] = y[2]
        want = [[similarity._edit_distance(p, q) for q in y] for p in x]
        for lanes, room in ((1 << 14, 1 << 23), (30, 1 << 23), (1 << 14, 50)):
            assert similarity.each_edit_distance(x, y, lanes, room).tolist() == want
    assert similarity._edit_distance(np.array([0, 1, 2, 2, 3, 4]), np.array([5, 1, 2, 2, 1, 4, 6])) == 3
    sets = [None, np.array([0, 5000]), np.array([], int), np.array([1, 2, 0])]
    assert similarity.each_set_jaccard(sets, sets).tolist() == [[1, 1, 1, 1], [1, 1, 0, 0.25], [1, 0, 1, 0], [1, 0.25, 0, 1]]


def test_edit_pairs_are_whole(spark):
    """Each pair of users once, whatever their numbers, in blocks of any size; copies, empty lists, nulls and items without a key."""
    from weftgraph import queries
    from weftgraph.session import new_path

    rng = np.random.default_rng(11)
    rows = [(i * 3, [f"t{x}" for x in rng.integers(0, 4, rng.integers(0, 5))]) for i in range(150)] + [(1, None), (2, []), (4, ["a", None, "b"]), (5, ["a", "b"]), (None, ["a"])]
    df = spark.createDataFrame(rows, "id int, tokens array<string>")

    def sim(x, y):
        if x is None or y is None or not x + y:
            return 1.0
        p, q = ([sum(map(ord, z)) for z in w if z is not None] for w in (x, y))
        return round(1 - similarity._edit_distance(np.array(p), np.array(q)) / max(len(x), len(y)), 6)

    want = {(i, j): sim(x, y) for i, x in rows for j, y in rows if i is not None and j is not None and i < j}
    for block, chunk in ((70, 9), (2048, 64)):
        got = pairs.token_edit_pairs(df, "id", "tokens", 6, block, chunk)
        assert dict(got.dtypes) == {"a": "int", "b": "int", "sim": "double"}
        got = got.collect()
        assert len(got) == len(want) and {(r.a, r.b): r.sim for r in got} == want
    events = [(10 * u + k, u, f"e{(u + k) % 3}") for u in range(25) for k in range(4)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.parquet((d := new_path(spark, "small")) + "/events.parquet")
    assert queries.sim5_token_edit(spark, d).count() == 25 * 24 // 2


def test_comparison_in_blocks(spark, tmp_path):
    """The rows of all ordered pairs of different graphs, through a file in pieces too, which reads back as Spark reads a whole one; the shared folder keeps no pairs."""
    import os

    from weftgraph import file_queries, queries
    from weftgraph.session import new_path, shared_dir

    rng = np.random.default_rng(12)
    items = [(f"g{i % 4}" if i else None, f"c{i % 4}", sorted({int(x) for x in rng.integers(0, 6, 4)}) if i % 7 else None, [f"t{x}" for x in rng.integers(0, 3, i % 6)]) for i in range(150)]
    df = spark.createDataFrame(items, "graph string, class string, features array<int>, tokens array<string>")
    plain = pairs.ordered_pairs(df, "graph", ["class", "features", "tokens"])
    want = sorted(map(tuple, plain.select("class_a", "class_b", similarity.token_edit_similarity(F.col("tokens_a"), F.col("tokens_b")), similarity.set_jaccard(F.col("features_a"), F.col("features_b"))).collect()))
    for block, chunk in ((70, 9), (2048, 64)):
        assert sorted(map(tuple, pairs.edit_and_set_pairs(df, block=block, chunk=chunk).collect())) == want
    classes = pa.array(["1", "a,b", 'q"r', None])
    with open(tmp_path / "piece.csv", "wb") as file:
        sinks.write_comparison_piece(file, classes, classes, np.array([0.0, 0.5, 1.0, 0.12346]), np.array([1.0, 0.25, 0.0, 0.33333]))
    read = [tuple(r) for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "piece.csv")).collect()]
    assert read == [tuple(r.values()) for r in delimited.comparison_piece(str(tmp_path / "piece.csv")).to_pylist()] and read[1] == ("a,b", "a,b", "0.50000", "0.25000")
    events = [(10 * u + k, u, f"e{(u * k) % 5}") for u in range(400) for k in range(4)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.parquet((d := new_path(spark, "small")) + "/events.parquet")
    folder = shared_dir(spark).removeprefix("file://") + "/weftgraph"
    for run in (file_queries.snk8_comparison_file, queries.ev10_jn7_e10_edit_versus_sketch):
        before = set(os.listdir(folder))
        df = run(spark, d)
        assert df.count() == 400 * 360 and "CartesianProduct" in df._jdf.queryExecution().executedPlan().toString()
        made = [os.path.join(at, f) for x in set(os.listdir(folder)) - before for at, _, files in os.walk(f"{folder}/{x}") for f in files]
        assert sum(map(os.path.getsize, made)) < 300_000


def test_blocks_of_vectors_are_not_shuffled(spark):
    """Pairs of blocks meet where they are read: no exchange lies above their join, and groups that share a block or take several give each pair once."""
    rows = [(i, i % 3 if i < 300 else i, [float(i), 1.0]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g int, v array<double>")
    kernel = lambda x, y, turned: {"s": similarity.each_sum(x[0], y[0], np.add)[0]}
    grouped = pairs.kernel_pairs(df, "id", ["v"], kernel, {"s": pa.float64()}, by="g", block=70)
    assert sorted(map(tuple, grouped.collect())) == [(i, j, i + j + 2.0) for i in range(300) for j in range(i + 3, 300, 3)]
    for made, n in ((grouped, 3 * 100 * 99 // 2), (pairs.lookup_all(df.select("id", "v"), 9, block=70), 400 * 400)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert made.count() == n and "CartesianProduct" in plan and "Exchange" not in plan
