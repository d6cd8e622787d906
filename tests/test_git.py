from provmill.operators import git
from provmill.sources import captures

# a <- b <- c <- d <- f (main), c <- e (topic, merged as second parent of f), b <- g (old)
COMMITS = [("r", 0, "a", []), ("r", 1, "b", ["a"]), ("r", 2, "c", ["b"]), ("r", 3, "e", ["c"]), ("r", 4, "d", ["c"]), ("r", 5, "f", ["d", "e"]), ("r", 6, "g", ["b"]), ("r", 7, "h", ["g"]), ("q", 0, "x", []), ("q", 1, "y", ["x"])]


def frames(spark, branches):
    commits = spark.createDataFrame([(*c, "Ann", "ann@example.com", 60 * c[1], f"do {c[2]}\n\nbody") for c in COMMITS], "repo string, pos int, sha string, parents array<string>, author_name string, author_email string, time long, message string")
    return commits, spark.createDataFrame(branches, "repo string, name string, tip string")


BRANCHES = [("r", "main", "f"), ("r", "topic", "e"), ("r", "fix/old", "h"), ("r", "same", "f"), ("q", "trunk", "y"), ("q", "other", "y")]


def test_bases(spark):
    commits, branches = frames(spark, BRANCHES)
    pairs = spark.createDataFrame([("r", "f", "h"), ("r", "f", "e"), ("r", "e", "h"), ("r", "f", "f")], "repo string, a string, b string")
    assert {(r.a, r.b): r.base for r in git.merge_bases(commits, pairs).collect()} == {("f", "h"): "b", ("f", "e"): "e", ("e", "h"): "b", ("f", "f"): "f"}
    # a merged branch and one with the default's tip start at the oldest commit
    assert {(r.repo, r.name): r.base for r in git.branch_bases(commits, branches).collect()} == {("r", "main"): "a", ("r", "topic"): "a", ("r", "fix/old"): "b", ("r", "same"): "a", ("q", "trunk"): "x", ("q", "other"): "x"}
    assert {(r.repo, r.name) for r in git.default_branches(branches).collect()} == {("r", "main"), ("q", "trunk")}
    assert {r.repo: r.start for r in git.default_branch_starts(commits, branches).collect()} == {"r": "a", "q": "x"}
    assert [(r.name, r.subject, r.ts) for r in git.branch_listing(commits, branches.where("repo = 'r'")).collect()][:2] == [("fix/old", "do h", "1970-01-01T00:07:00Z"), ("main", "do f", "1970-01-01T00:05:00Z")]


def test_reach_has_a_row_a_commit(spark):
    """300 commits under 40 tips; bases and oldest commits as by brute force over sets."""
    import random

    rng = random.Random(4)
    up = {0: []} | {i: sorted({rng.randrange(max(0, i - 12), i) for _ in range(rng.choice((1, 1, 1, 2)))}) for i in range(1, 300)}
    up[150] = []  # a second root
    name = lambda i: f"{i * 7919 % 1000:03d}x"
    commits = spark.createDataFrame([("r", i, name(i), [name(p) for p in up[i]], "A", "a@b", i, "m") for i in up], "repo string, pos int, sha string, parents array<string>, author_name string, author_email string, time long, message string").repartition(3)
    tips = sorted(rng.sample(range(100, 300), 40))
    below = {}
    for i in up:
        below[i] = {i}.union(*(below[p] for p in up[i]))
    branches = spark.createDataFrame([("r", "main" if k == 0 else f"b{k}", name(t)) for k, t in enumerate(tips)], "repo string, name string, tip string")
    got, order = git.reach(commits, branches).collect(), sorted(name(t) for t in tips)
    assert len(got) == len(set().union(*(below[t] for t in tips)))
    bits = {r.sha: {order[n] for n in range(40) if int.from_bytes(r.tips, "little") >> n & 1} for r in got}
    assert bits == {name(i): {name(t) for t in tips if i in below[t]} for i in up if any(i in below[t] for t in tips)}
    pairs = [(a, b) for a in tips[:6] for b in tips]
    found = {(r.a, r.b): r.base for r in git.merge_bases(commits, spark.createDataFrame([("r", name(a), name(b)) for a, b in pairs], "repo string, a string, b string")).collect()}
    assert found == {(name(a), name(b)): name(max(below[a] & below[b])) for a, b in pairs if below[a] & below[b]}
    assert {r.tip: r.oldest for r in git.oldest_commits(commits, branches).collect()} == {name(t): name(min(below[t])) for t in tips}
    based = branches.join(git.branch_bases(commits, branches), ["repo", "name"])
    own = {}
    for r in git.branch_commits(commits, based).collect():
        own.setdefault(r.name, {})[r.pos] = r.sha
    number = {name(i): i for i in up}
    for r in based.collect():
        want = sorted(below[number[r.tip]] - below[number[r.base]])
        assert [own.get(r.name, {}).get(k) for k in range(len(want))] == [name(i) for i in want] and len(own.get(r.name, {})) == len(want)


def test_a_default_branch_with_a_start_of_its_own(spark):
    commits, branches = frames(spark, BRANCHES)
    from pyspark.sql import functions as F

    given = branches.withColumn("start", F.when((F.col("repo") == "r") & (F.col("name") == "main"), "d"))
    assert {r.repo: r.start for r in git.default_branch_starts(commits, given).collect()} == {"q": "x"}


def test_paths_of_branches(spark):
    commits, branches = frames(spark, BRANCHES)
    files = spark.createDataFrame([("h", "f.txt", "@@")], "sha string, path string, patch string")
    repositories = spark.createDataFrame([("r", "git@github.com:o/r.git", "/r/.git"), ("q", None, "/home/q/.git")], "repo string, remote string, git_dir string")
    paths, steps = git.branch_paths(commits, files, branches, repositories)
    got = {r.path_id: r for r in paths.collect()}
    assert got["r#path-fix-old"].base_ref == "b" and got["r#path-fix-old"].head == "step-h" and got["r#path-fix-old"].title == "Branch: fix/old"
    assert got["r#path-main"].base_uri == "github:o/r" and got["q#path-other"].base_uri == "file:///home/q"
    made = {}
    for r in steps.orderBy("path_id", "pos").collect():
        made.setdefault(r.path_id, []).append((r.step_id, r.parents))
    assert made["r#path-fix-old"] == [("step-g", []), ("step-h", ["step-g"])]  # the base is no parent
    assert [s for s, _ in made["r#path-main"]] == ["step-b", "step-c", "step-e", "step-d", "step-f"]
    assert "q#path-trunk" in made
    fixed, _ = git.branch_paths(commits, files, branches.where("name = 'topic'"), base="c")
    assert [(r.base_ref, r.base_uri) for r in fixed.collect()] == [("c", "file://unknown")]


def test_patches(spark):
    value = "abc123\n\ndiff --git a/old b/new\nsimilarity index 90%\n--- a/old\n+++ b/new\n@@ -1 +1 @@\n-x\n+diff --git\n@@ -9 +9 @@\n-y\ndiff --git a/bin b/bin\nBinary files a/bin and b/bin differ\ndiff --git a/gone b/gone\n--- a/gone\n+++ /dev/null\n@@ -1 +0,0 @@\n-z\n"
    got = captures.patches(spark.createDataFrame([("abc123", value)], "sha string, value string")).collect()
    assert {(r.path, r.patch) for r in got} == {("new", "@@ -1 +1 @@\n-x\n+diff --git\n@@ -9 +9 @@\n-y\n"), ("gone", "@@ -1 +0,0 @@\n-z\n")}


def test_patches_from_a_capture(spark, tmp_path):
    (tmp_path / "log").write_text("".join(f"\x1e{sha}\n\ndiff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -1 +1 @@\n-{sha}\n" for sha in ("aa", "bb")))
    assert {(r.sha, r.path) for r in captures.git_patches(spark, str(tmp_path / "log")).collect()} == {("aa", "f"), ("bb", "f")}
    assert captures.pull_request_list(spark.createDataFrame([('{"number":4,"head":{"ref":"x"}}',)], "raw string")).first().head_branch == "x"
