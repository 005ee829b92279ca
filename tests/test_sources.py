"""History, changes and revisions as partitioned sources; workspaces by URI; facts by content."""

import os
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from brickyard.plans.facts_table import FactsTable
from brickyard.sources import git
from brickyard.sources.workspace import Revision, Tree, blob_id, is_workspace, read_config, read_settings


def run(root, *args, **env):
    done = subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.com", *args], check=True, capture_output=True, env=os.environ | env)
    return done.stdout.decode()


def write(root, files):
    for name, text in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    """Thirty commits on two branches that a merge joins without taking the second's changes."""
    root = tmp_path_factory.mktemp("history")
    run(root, "init", "-q", "-b", "main")
    for i in range(30):
        write(root, {f"bases/a/f{i % 4}": str(i), f"components/b é/ü {i % 5}": f"{i}\n"})
        run(root, "add", "-A")
        run(root, "commit", "-qm", f"c{i}", GIT_COMMITTER_DATE=f"{1_700_000_000 + i * 86_400} +0000")
        if i in (10, 15):
            run(root, "checkout", "-q", *(["-b", "side"] if i == 10 else ["main"]))
    run(root, "merge", "-q", "-s", "ours", "side")
    return root


def logged(root, *args):
    found, commit = set(), None
    for line in run(root, "-c", "core.quotePath=false", "log", "--no-merges", "--name-only", "--format=@%H", *args).splitlines():
        if line.startswith("@"):
            commit = line[1:]
        elif line:
            found.add((commit, line))
    return found


def test_log_in_partitions(spark, repo):
    log = git.log(spark, str(repo), per_partition=5)
    assert log.rdd.getNumPartitions() >= 4
    rows = [(r.commit, r.path) for r in log.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == logged(repo)
    since = git.log(spark, str(repo), since="2023-12-01T00:00:00Z", per_partition=3)
    assert {(r.commit, r.path) for r in since.collect()} == logged(repo, "--since=2023-12-01T00:00:00Z")
    with pytest.raises(git.GitError):
        git.log(spark, "/")


def test_log_takes_filters(spark, repo):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        log = git.log(spark, str(repo), per_partition=5)
        inside = log.filter(F.col("path").startswith("bases/"))
        assert {(r.commit, r.path) for r in inside.collect()} == {x for x in logged(repo) if x[1].startswith("bases/")}
        late = git.log(spark, str(repo), per_partition=5).filter(F.col("at") >= F.lit("2023-12-05 00:00:00").cast("timestamp"))
        assert late.rdd.getNumPartitions() < log.rdd.getNumPartitions()  # git walks fewer commits
        assert {r.commit for r in late.collect()} == {c for c, _ in logged(repo, "--since=2023-12-05T00:00:00Z")}
        one = git.log(spark, str(repo)).filter(F.col("path") == "components/b é/ü 1")
        assert {r.commit for r in one.collect()} == {c for c, p in logged(repo) if p == "components/b é/ü 1"}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_log_as_stream(spark, repo, tmp_path):
    copy = tmp_path / "clone"
    subprocess.run(["git", "clone", "-q", str(repo), str(copy)], check=True)
    stream = git.register(spark).readStream.format("gitlog").option("perPartition", 7).load(str(copy))
    query = stream.writeStream.format("memory").queryName("commits").option("checkpointLocation", f"file://{tmp_path}/state").start()
    try:
        query.processAllAvailable()
        assert {(r.commit, r.path) for r in spark.table("commits").collect()} == logged(copy)
        write(copy, {"new": "1", "bases/a/f0": "later"})
        run(copy, "add", "-A")
        run(copy, "commit", "-qm", "more")
        query.processAllAvailable()
        rows = [(r.commit, r.path) for r in spark.table("commits").collect()]
        assert len(rows) == len(set(rows)) and set(rows) == logged(copy)
    finally:
        query.stop()


def test_co_change_of_a_commit_stream(spark, repo, tmp_path):
    from brickyard.streaming.co_change import co_change_windows, commit_stream

    copy = tmp_path / "streamed"
    subprocess.run(["git", "clone", "-q", str(repo), str(copy)], check=True)
    start = run(copy, "rev-list", "--no-merges", "HEAD").split()[12]
    windows = co_change_windows(commit_stream(spark, str(copy), start), late="100 days")
    query = windows.writeStream.outputMode("complete").format("memory").queryName("joint").option("checkpointLocation", f"file://{tmp_path}/joint").start()
    try:
        query.processAllAvailable()
        first = spark.table("joint").agg(F.sum("shared")).first()[0]
        touched = {}
        for commit, path in logged(copy, f"{start}..HEAD"):
            touched.setdefault(commit, set()).add(path.split("/")[1])
        assert first == sum({"a", "b é"} <= x for x in touched.values()) > 0
        write(copy, {"bases/a/f0": "x", "components/b é/ü 0": "y", "components/c/z": "1"})
        run(copy, "add", "-A")
        run(copy, "commit", "-qm", "three", GIT_COMMITTER_DATE="1702000000 +0000")
        query.processAllAvailable()
        assert spark.table("joint").agg(F.sum("shared")).first()[0] == first + 3
    finally:
        query.stop()


def test_files_of_a_revision(spark, repo):
    rev = run(repo, "rev-parse", "HEAD~2").strip()
    files = git.register(spark).read.format("gitfiles").options(rev=rev, perPartition="2").load(str(repo))
    assert files.rdd.getNumPartitions() >= 4
    want = {p: run(repo, "show", f"{rev}:{p}") for p in run(repo, "-c", "core.quotePath=false", "ls-tree", "-r", "--name-only", rev).splitlines()}
    rows = files.withColumn("made", blob_id(F.col("source"))).collect()
    assert {r.path: r.source for r in rows} == want and all(r.made == r.oid for r in rows)
    write(repo, {"bases/a/f1": "now", "untracked": "x"})
    changed = {r.path for r in git.changed_files(spark, str(repo), rev).collect()}
    assert changed == set(run(repo, "-c", "core.quotePath=false", "diff", "--name-only", rev).splitlines()) | {"untracked"}


FILES = {
    "workspace.edn": '{:top-namespace "top"}',
    "brickyard.edn": "{:complexity {:function-complexity {:error 1}}}",
    "components/one/src/top/one/a+b c%20.clj": "(ns top.one.interface) (defn f [x] (if x 1 2))",
    "components/one/test/top/one/t_test.clj": "(ns top.one.t-test) (deftest t (is 1))",
    "components/two/src/top/two/core.cljc": "(ns top.two.core)",
    "components/two/src/top/two/twin.cljc": "(ns top.two.core)",
    "components/none/readme": "",
    "bases/web/src/top/web/main.clj": "(ns top.web.main) (defn -main [] 1)",
}


@pytest.mark.parametrize("kind", ["path", "uri"])
def test_tree_with_odd_names(spark, tmp_path, kind):
    root = tmp_path / "a b%20[x]"
    write(root, FILES)
    tree = Tree(spark, str(root) if kind == "path" else f"file://{root}")
    assert is_workspace(tree) and read_settings(tree).top == "top" and read_config(tree)["complexity"]
    assert [tuple(r) for r in tree.bricks().orderBy("ord").collect()] == [(0, "web", "base", "bases/web"), (1, "none", "component", "components/none"), (2, "one", "component", "components/one"), (3, "two", "component", "components/two")]
    rows = {r.file: (r.brick, r.is_test, r.source) for r in tree.files().collect()}
    assert rows == {n: (n.split("/")[1], "/test/" in n, t) for n, t in FILES.items() if ".clj" in n}
    assert tree.local == str(root) and tree.name == root.name
    assert not is_workspace(Tree(spark, str(tmp_path)))
    with pytest.raises(FileNotFoundError):
        read_config(tree, "no/such.edn")


def test_facts_by_content(spark, tmp_path):
    root = tmp_path / "ws"
    write(root, FILES)
    run(tmp_path, "init", "-q", str(root))
    run(root, "add", "-A")
    run(root, "commit", "-qm", "one")
    folder = f"file://{tmp_path}/facts"
    first = FactsTable(spark, folder)
    facts = {r.file: r for r in first.of(Tree(spark, str(root)).files()).collect()}
    assert first.parsed == 4 and len(facts) == 5  # two files are alike
    assert [f.name for f in facts["components/one/src/top/one/a+b c%20.clj"].functions] == ["f"]
    base = Revision(spark, str(root), "HEAD")
    assert is_workspace(base) and {tuple(r) for r in base.bricks().select("brick", "ord").collect()} == {("web", 0), ("none", 1), ("one", 2), ("two", 3)}
    again = {r.file: r for r in first.of(base.files()).collect()}
    assert first.parsed == 4 and again == facts  # the same contents in a revision
    write(root, {"components/two/src/top/two/twin.cljc": "(ns top.two.twin)", "components/two/src/top/two/more.clj": "(def x 1)"})
    second = FactsTable(spark, folder)
    assert second.of(Tree(spark, str(root)).files()).count() == 6 and second.parsed == 2
    third = FactsTable(spark, folder)
    assert third.of(Tree(spark, str(root)).files()).count() == 6 and third.parsed == 0


def test_reader_stops_git(repo):
    told = git._told(str(repo), "log", "-z", "--format=%H")
    assert next(told)
    told.close()
    time.sleep(0.1)
