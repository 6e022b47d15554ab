"""Publishing: only what changed is written, a broken build and the slower of two publishers leave the pointer alone."""

import glob

import pytest
from pyspark.sql import functions as F

from quarterbook.operators import merkle
from quarterbook.sources import publisher, snapshots
from quarterbook.sources.commits import Conflict


def artifacts(spark, **bodies):
    return spark.createDataFrame([(k.replace("_", "/"), v) for k, v in bodies.items()], "key string, body string")


def files(root, build):
    return [p for p in glob.glob(f"{root}/files/build={build}/*/*.txt")]


def test_one_changed_artifact_is_one_file(spark, tmp_path):
    root = str(tmp_path)
    told = publisher.publish_artifacts(artifacts(spark, f1_q1='{"a":1}', f1_q2='{"a":2}', f2_q1='{"é":3}'), root, "b1")
    assert told == {"artifacts": 3, "written": 3, "kept": 0, "lost": 0, "pruned": 0} and len(files(root, "b1")) == 3
    told = publisher.publish_artifacts(artifacts(spark, f1_q1='{"a":1}', f1_q2='{"a":9}', f2_q1='{"é":3}'), root, "b2")
    assert told["written"] == 1 and told["kept"] == 2 and len(files(root, "b2")) == 1
    assert snapshots.current_build(spark, root) == "b2"
    assert {tuple(r) for r in publisher.bodies(spark, root).collect()} == {("f1/q1", '{"a":1}'), ("f1/q2", '{"a":9}'), ("f2/q1", '{"é":3}')}
    assert publisher.artifact(spark, root, "f1/q2") == '{"a":9}' and publisher.artifact(spark, root, "f9/q9") is None
    # what a build lacks stays, unless it is pruned
    told = publisher.publish_artifacts(artifacts(spark, f1_q1='{"a":1}'), root, "b3")
    assert told["lost"] == 2 and told["written"] == 0 and publisher.bodies(spark, root).count() == 3
    told = publisher.publish_artifacts(artifacts(spark, f1_q1='{"a":1}'), root, "b4", prune=True)
    assert told["pruned"] == 2 and publisher.bodies(spark, root).count() == 1


def test_many_artifacts_share_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(publisher, "MOST_FILES", 8, raising=False)
    root, odd = str(tmp_path), "f/%\té 1"
    rows = lambda told: spark.createDataFrame([(f"f{n}", f"{told if n in (7, 30) else ''}a\tb\r{n}") for n in range(40)] + [(odd, "\todd")], "key string, body string")
    assert publisher.publish_artifacts(rows("one"), root, "b1")["written"] == 41 and 1 < len(files(root, "b1")) <= 8
    assert publisher.publish_artifacts(rows("two"), root, "b2") == {"artifacts": 41, "written": 2, "kept": 39, "lost": 0, "pruned": 0} and len(files(root, "b2")) == 2
    found = [tuple(r) for r in publisher.bodies(spark, root).collect()]
    assert sorted(found) == sorted([(f"f{n}", f"{'two' if n in (7, 30) else ''}a\tb\r{n}") for n in range(40)] + [(odd, "\todd")])
    assert publisher.artifact(spark, root, odd) == "\todd" and publisher.artifact(spark, root, "none") is None
    asked = spark.createDataFrame([("f1",), ("f7",), ("none",)], "key string")
    assert {tuple(r) for r in publisher.bodies(spark, root, asked).collect()} == {("f1", "a\tb\r1"), ("f7", "twoa\tb\r7")}
    with pytest.raises(publisher.Refused, match="several lines"):
        publisher.publish_artifacts(artifacts(spark, a="1\n2"), root, "b3")


def test_files_grow_with_bytes_beyond_a_share(spark):
    keys = spark.range(20_000).selectExpr("cast(id as string) as key")
    count = lambda n, size: keys.select(publisher.file_of(n, size).alias("f")).distinct().count()
    assert count(500, 1) == 20_000 and count(501, 1) == 500 and count(20_000, 1000 * publisher.BYTES_A_FILE) == 1000


def test_a_broken_build_is_refused_before_its_pointer_moves(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    good = artifacts(spark, a="1", b="2", c="3")
    publisher.publish_artifacts(good, root, "good")
    short = {"short": F.length("body") < 3}
    for name, rows, expect, fewest in (("long", artifacts(spark, a="1", b="2222"), short, 1), ("null", artifacts(spark, a=None, b="1"), {}, 1), ("twice", good.unionByName(good), {}, 1), ("few", good, short, 4)):
        with pytest.raises(publisher.Refused):
            publisher.publish_artifacts(rows, root, name, expect, fewest)
        assert snapshots.current_build(spark, root) == "good" and not files(root, name)
    monkeypatch.setattr(publisher, "MOST_PRUNED", 1)
    with pytest.raises(publisher.Refused, match="pruned"):
        publisher.publish_artifacts(artifacts(spark, a="1"), root, "thin", prune=True)
    assert publisher.publish_artifacts(good, root, "next", short, 3)["written"] == 0


def test_of_two_publishers_one_fails(spark, tmp_path):
    root = str(tmp_path)
    publisher.publish_artifacts(artifacts(spark, a="1"), root, "b1")
    seen = snapshots.pointer(spark, root)
    publisher.publish_artifacts(artifacts(spark, a="2"), root, "b2", after=seen)
    with pytest.raises(Conflict):
        publisher.publish_artifacts(artifacts(spark, a="3"), root, "b3", after=seen)
    assert snapshots.current_build(spark, root) == "b2" and publisher.artifact(spark, root, "a") == "2"
    tables = {"t": spark.range(2)}
    with pytest.raises(Conflict):
        snapshots.publish(tables, root, "b4", after=seen)
    for n in range(3, 13):  # numbers, not names or times, say which is the newest
        assert snapshots.publish(tables, root, f"b{n}") == n
    assert snapshots.current_build(spark, root) == "b12"


def test_trees_are_compared_where_they_differ(spark):
    rows = [(f"{cik:03}", f"2024-0{q}-01", f"d{cik}{q}") for cik in range(40) for q in range(1, 4)]
    table = lambda r: spark.createDataFrame(r, "cik string, period_end string, digest string")
    one, again = (merkle.tree(merkle.by_fund(table(r))) for r in (rows, rows[::-1]))
    root = lambda t: t.where("level = 0").first()
    assert root(one).digest == root(again).digest and root(one).leaves == 120
    assert merkle.changed_leaves(one, again).count() == 0
    other = [r for r in rows if r[:2] != ("007", "2024-02-01") and r[0] != "011"] + [("007", "2024-05-01", "x"), ("100", "2024-01-01", "y")]
    other = [(c, q, "new" if (c, q) == ("020", "2024-03-01") else d) for c, q, d in other]
    two = merkle.tree(merkle.by_fund(table(other)))
    changed = merkle.changed_leaves(one, two)
    assert {(*r.path.split("/")[2:], r.verdict) for r in changed.collect()} == {
        ("007", "2024-02-01", "lost"), ("007", "2024-05-01", "added"), ("020", "2024-03-01", "changed"), ("100", "2024-01-01", "added"), *(("011", f"2024-0{q}-01", "lost") for q in (1, 2, 3))
    }
    assert {(r.path.split("/")[2], r.before, r.after) for r in merkle.losses(one, two, changed).collect()} == {("007", 3, 3), ("011", 3, 0)}
    expected = spark.createDataFrame([(one.where("level = 3 and path like '%/011'").first().path, 3), ("", 119)], "path string, fewest long")
    assert {(r.fewest, r.leaves) for r in merkle.unmet(two, expected).collect()} == {(3, 0), (119, 118)}
    none = merkle.tree(merkle.by_fund(table(rows).limit(0)))
    assert merkle.changed_leaves(none, one).where("verdict = 'added'").count() == 120
