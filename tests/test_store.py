import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from keyloom.operators import graph, lookup
from keyloom.operators.catalog import Catalog
from keyloom.operators.ordered import with_running_sum
from keyloom.operators.seq import Seq
from keyloom.sources import samples
from keyloom.sources.json_out import to_json
from keyloom.sources.tables import parse_ddl, read_csv, read_json, register_table, write_index
from keyloom.streaming.mutlog import compact, fold
from keyloom.streaming.pov import Store
from keyloom.streaming.tail import fold_stream, promote_stream, tail

LOG = "pov_id string, seq long, update_id string, k int, mutator string, op long, tombstone boolean"


def by_hand(rows):
    out = {}
    for k in {r[3] for r in rows}:
        own, seen, kept = sorted((r for r in rows if r[3] == k), key=lambda r: -r[1]), set(), []
        for r in own:
            if r[2] not in seen:
                kept.append(r)
                seen.add(r[2])
        first = kept[0]
        if first[6]:
            continue
        acc = first[5]
        if first[4] != "assign":
            for r in kept[1:]:
                if r[6] or r[4] not in (first[4], "assign"):
                    break
                acc = {"add": r[5] + acc, "max": max(r[5], acc), "min": min(r[5], acc), "mult": r[5] * acc}[first[4]]
                if r[4] == "assign":
                    break
        out[k] = acc
    return out


@pytest.mark.parametrize("seed", range(3))
def test_fold_and_compaction(spark, seed):
    r = random.Random(seed)
    rows = []
    for s in range(300):
        gone = r.random() < 0.06
        m = r.choice(["add", "add", "max", "min", "mult", "assign"])
        rows.append(("global", s, f"u{s if r.random() < 0.9 else max(0, s - 1)}", r.randrange(25), None if gone else m, None if gone else r.choice([-2, 1, 3]), gone))
    want = by_hand(rows)
    log = spark.createDataFrame(rows, LOG)
    assert {x["k"]: x["value"] for x in fold(log, ["k"]).collect()} == want
    assert {x["k"]: x["value"] for x in fold(compact(log, ["k"]), ["k"]).collect()} == want
    unique = [(*x[:2], f"u{x[1]}", *x[3:]) for x in rows]
    parts = compact(spark.createDataFrame(unique[:150], LOG), ["k"]).unionByName(compact(spark.createDataFrame(unique[150:], LOG), ["k"], whole=False))
    assert {x["k"]: x["value"] for x in fold(parts, ["k"]).collect()} == by_hand(unique)


def test_store_branches(spark):
    s = Store(spark, [("k", "string")], "bigint")
    a, b = s.new_pov(), s.new_pov()
    s.call(a, lambda c: c.mutate(("x",), "add", 5))
    s.call(b, lambda c: (c.mutate(("x",), "add", 1), c.mutate(("x",), "add", 2)))
    assert s.call(a, lambda c: c.get("x")) == 5 and s.call("global", lambda c: c.get("x", default=0)) == 0
    assert s.promote(a) == 1 and s.promote(b) == 1
    assert [tuple(r) for r in s.read().collect()] == [("x", 8)]
    with pytest.raises(ValueError):
        s.call(a, lambda c: (c.mutate(("x",), "add", 5), c.mutate(("x",), "max", 5)))
    s.call("global", lambda c: c.mutate(("x",), "sub", 3))
    s.compact()
    assert [tuple(r) for r in s.read().collect()] == [("x", 5)]
    with pytest.raises(KeyError):
        s.call("global", lambda c: c.mutate(("y",), "sub", 3))
    s.call("global", lambda c: c.delete(("x",)))
    assert s.read().count() == 0
    s.append(spark.createDataFrame([("x", "add", 4, False), ("z", "assign", 1, False)], "k string, mutator string, op long, tombstone boolean"))
    assert sorted(map(tuple, s.read().collect())) == [("x", 4), ("z", 1)]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("g", 1, "a", 1, "add", 5, False), ("g", 2, "b", 1, "add", 6, False), ("g", 3, "c", 2, "assign", 6, False)], LOG)
    src = str(tmp_path / "in")
    rows.write.parquet(src)
    promote_stream(tail(spark, src, LOG, 1), str(tmp_path / "log"), str(tmp_path / "c1"), "parent").awaitTermination()
    moved = spark.read.parquet(str(tmp_path / "log"))
    assert moved.count() == 3 and {r[0] for r in moved.select("pov_id").collect()} == {"parent"}
    fold_stream(tail(spark, src, LOG), ["k"], str(tmp_path / "state"), str(tmp_path / "c2")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "state/value")).collect())) == [(1, 11), (2, 6)]


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 4)], "src long, dst long")
    seeds = spark.createDataFrame([(1,), (4,)], "seed long")
    assert sorted(map(tuple, graph.reach(e, seeds).collect())) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 1), (4, 4, 0)]
    assert graph.shortest_path_length(e, 2, 4) == 3 and graph.shortest_path_length(e, 4, 1) is None and graph.shortest_path_length(e, 1, 1) == 0
    assert graph.shortest_path_length(e, 2, 4, limit=2) is None


def test_sequences(spark):
    e = spark.createDataFrame([(k, v) for k, v in enumerate("AABCCB")], "i int, v string")
    s = Seq(e, [("i", True)])
    assert [tuple(r) for r in s.collated_by("v", n=F.count("*")).to_frame().select("v", "n").collect()] == [("A", 2), ("B", 1), ("C", 2), ("B", 1)]
    assert s.take(-1).df.count() == 0 and s.skip(4).df.count() == 2
    assert s.to_list(F.col("v")).first()[0] == list("AABCCB") and s.reversed().to_list(F.col("v")).first()[0] == list("BCCBAA")
    assert s.take_while(F.col("v") == "A").df.count() == 2 and Seq(e.where("i < 0"), [("i", True)]).take_while(F.col("v") == "A").df.count() == 0
    nulls = Seq(spark.createDataFrame([(1, None), (2, None), (3, "x")], "i int, v string"), [("i", True)])
    assert nulls.collated_by("v", n=F.count("*")).df.count() == 2 and nulls.to_set(F.col("v")).first()[0] == [None, "x"]
    with pytest.raises(ValueError):
        Seq.range(spark, 3, 0, 4)
    with pytest.raises(ValueError):
        Seq.range(spark, 3).to_frame()
    pairs = spark.createDataFrame([("x", "a", 1, 1), ("x", "b", 1, 2), ("x", "b", 2, 3), ("y", "a", 9, 4)], "k string, t string, i int, v int")
    for order, want in (([("t", True), ("i", True)], 3), ([("t", False), ("i", False)], 1), ([("t", False), ("i", True)], 1), ([("t", True), ("i", False)], 2)):
        assert Seq(pairs, order).to_dict(F.col("k"), F.col("v")).first()[0] == {"x": want, "y": 4}
    run = with_running_sum(e, [("i", False)], F.lit(1), "n")
    assert sorted((r["i"], r["n"]) for r in run.collect()) == [(k, 6 - k) for k in range(6)]


def test_parent_chain_of_a_cycle(spark):
    rows = [(1, 2), (2, 3), (3, 4), (4, 2)]
    assert lookup.parent_chain(spark.createDataFrame(rows[:3], "child long, parent long")).count() == 6
    with pytest.raises(ValueError, match="cycle"):
        lookup.parent_chain(spark.createDataFrame(rows, "child long, parent long"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_common_members_is_dealt_by_bytes(spark):
    """The pairs of a partition were counted in the join's own task, however many they were."""
    rows = [(s, p) for p in range(40) for s in range(p % 7 + 1)] * 2 + [(None, 1), (3, None)]
    got = lookup.common_members(spark.createDataFrame(rows, "s int, p int"), "s", "p")
    assert "Join" not in plan(got) and "REBALANCE_PARTITIONS_BY_COL" in plan(got)
    own = {s: {p for t, p in rows if t == s and p is not None} for s in range(7)}
    assert {(r["a"], r["b"]): r["n_common"] for r in got.collect()} == {(a, b): len(own[a] & own[b]) for a in own for b in own if a < b and own[a] & own[b]}


def test_take_while_of_mixed_order_sorts_nothing(spark):
    """Of an order that a text leads, one task sorted all rows."""
    rows = [("b", 1, 9), ("b", 2, 1), ("b", 2, 1), ("b", 3, 1), ("a", None, 1), ("a", 5, 1), (None, 7, 1), ("b", None, 1), ("c", 8, 1)]
    e = spark.createDataFrame(rows, "t string, i int, v int")

    def left(df, up=True):
        return sorted(map(str, Seq(df, [("t", up), ("i", not up)]).take_while(F.col("v") == 1).df.select("t", "i").collect()))

    got = Seq(e, [("t", True), ("i", False)]).take_while(F.col("v") == 1).df
    assert "Window" not in plan(got) and "Sort [" not in plan(got) and "TakeOrderedAndProject" in plan(got)
    want = lambda *r: sorted(str(Row(t=t, i=i)) for t, i in r)
    assert left(e) == want((None, 7), ("a", 5), ("a", None), ("b", 3), ("b", 2), ("b", 2))
    assert left(e, False) == want(("c", 8), ("b", None))
    assert left(e.where("i != 2").union(spark.createDataFrame([("b", 2, 1), ("b", 2, 9)], e.schema))) == want((None, 7), ("a", 5), ("b", 3))  # of one place, neither stays
    assert len(left(e.where("v = 1"))) == 8 and left(e.where("v = 9")) == []


def test_as_of_and_missing(spark):
    with pytest.raises(Exception, match="no value at key"):
        lookup.lookup(spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string"), ["k"], ["v"]).collect()


def test_tables(spark, tmp_path):
    t = parse_ddl("table city { id int not null; name str; big bool null; note str; primary key (id desc); by_name key (name); text note; }")["city"]
    assert t.primary == [("id", False)] and t.secondary == {"by_name": [("name", True)]}
    (tmp_path / "c.csv").write_text('1,"a, b",true,Old town\n2,c,,\n')
    df = read_csv(spark, str(tmp_path / "c.csv"), t)
    assert sorted(map(tuple, df.collect())) == [(1, "a, b", True, "Old town"), (2, "c", None, None)]
    (tmp_path / "d.csv").write_text(",a,true,x\n")
    with pytest.raises(Exception, match="id is null"):
        read_csv(spark, str(tmp_path / "d.csv"), t).collect()
    (tmp_path / "e.csv").write_text('1,"a\nb",true,x\n')
    assert read_csv(spark, str(tmp_path / "e.csv"), t, multi_line=True).first()["name"] == "a\nb"
    c = Catalog()
    register_table(c, t, df)
    assert [r[0] for r in c.keys("city", "record").to_frame().collect()] == [2, 1]
    assert c.values("city.note", "key", word="town").df.first()["id"] == 1
    assert c.read("city", "record", id=1).first()["name"] == "a, b"
    assert c.read("city", "record", optional=True, id=9).first()["name"] is None
    with pytest.raises(Exception, match="no value at"):
        c.read("city", "record", id=9).collect()
    with pytest.raises(ValueError):
        parse_ddl("table x { a int; primary key (b); }")
    (tmp_path / "j.json").write_text('{"Id": 1, "s": "x"}\n')
    assert read_json(spark, str(tmp_path / "j.json"), spark.createDataFrame([], "id long, s string").schema, {"id": "Id"}).first()[0] == 1
    write_index(df, str(tmp_path / "out"), ["id"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_json(spark):
    df = spark.range(1).select(F.struct(F.lit(1).alias("a"), F.array(F.lit(2)).alias("s")).alias("v"))
    assert to_json(df, "v").first()[0] == '{"a":1.0,"s":[2.0]}'
    v = spark.range(1).select(F.expr("named_struct('tag', 'B', 'A', cast(null as bigint), 'B', 'x')").alias("v"))
    assert to_json(v, "v").first()[0] == '{"B":"x"}'


def test_samples(spark):
    assert samples.complete_graph(spark, 4).count() == 12
    assert samples.beers(spark, 3, 2).count() == 6 and samples.tweets(spark, 3, 2).count() == 6 and samples.cast_list(spark, 2, 3).count() == 10
    assert samples.money_transfers(spark, 5, 7).count() == 7 and samples.social_graph(spark, 5)[1].count() == 15
    assert samples.image(spark, [((1, "a"), True)], "k0 int, k1 string, v boolean").count() == 1
