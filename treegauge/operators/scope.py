"""Scope: which paths are ours.  Rules, ignore files, tree states.

Prefix questions are answered by exploding the ancestors of *directories* and
joining on equality.  Directories are far fewer than files and are made
distinct with map-side combining first, so a folder that holds a third of all
files contributes one row to the fan-out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..functions import paths as P
from ..joins import lookup
from ..schemas import CHECKED, DIR, EXCLUDE, FILE, INCLUDE, PARTIAL, UNCHECKED

# Directory names that are build output or tool state.
JUNK = ("node_modules", ".venv", "venv", ".git", "__pycache__", ".mypy_cache",
        ".pytest_cache", ".tox", "target", "dist", "build", ".next", ".cache")

def rule_mode(path, rules: list[tuple[str, str]]) -> Column:
    """Mode of the innermost covering rule, or NULL; the expression grows with the rules.

    For streams and short lists; `innermost_rule` joins a table of any length.
    """
    last = dict(rules)
    chosen = F.lit(None).cast("string")
    # Longest last in the fold, so it is tested first.
    for root in sorted(last, key=len):
        chosen = F.when(P.under(path, root), F.lit(last[root])).otherwise(chosen)
    return chosen


def innermost_rule(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """`path, rule_path, mode` of the innermost rule; NULLs where none covers."""
    dirs = paths.select(P.dirname("path").alias("dir")).distinct()
    fanned = dirs.select(
        "dir", F.explode(F.array_distinct(
            F.concat(F.array(F.lit("/")), P.self_and_ancestors("dir")))).alias("rule_path"))
    keyed = rules.select(F.col("path").alias("rule_path"), "mode")
    from_dir = (fanned.join(keyed, "rule_path").groupBy("dir")
                .agg(F.max_by(F.struct("rule_path", "mode"), F.length("rule_path"))
                     .alias("from_dir")))
    own = rules.select("path", F.struct(F.col("path").alias("rule_path"), "mode")
                       .alias("own"))
    return (lookup(paths.withColumn("dir", P.dirname("path")), from_dir, ["dir"])
            .join(own, "path", "left")
            .withColumn("rule", F.coalesce("own", "from_dir"))
            .select(*paths.columns, F.col("rule.rule_path").alias("rule_path"),
                    F.col("rule.mode").alias("mode")))


# -- ignore files -----------------------------------------------------------

_LINE_ENDS = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"


def parse_ignore(text) -> Column:
    """`array<struct<pattern, negated, anchored, dir_only>>`, in file order."""
    text = F.col(text) if isinstance(text, str) else text
    lines = F.transform(F.split(text, _LINE_ENDS, -1),
                        lambda line: F.regexp_replace(line, r"(?U)\s+$", ""))
    usable = F.filter(lines, lambda line: ~F.rlike(line, F.lit(r"(?U)^\s*(#|$)")))

    def parsed(line: Column) -> Column:
        negated = F.startswith(line, F.lit("!"))
        body = F.when(negated, F.substring(line, F.lit(2), F.length(line))).otherwise(line)
        bare = F.rtrim(body, F.lit("/"))
        return F.struct(
            F.ltrim(bare, F.lit("/")).alias("pattern"),
            negated.alias("negated"),
            F.contains(bare, F.lit("/")).alias("anchored"),
            F.endswith(body, F.lit("/")).alias("dir_only"))

    return F.transform(usable, parsed)


def _quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.^$+{}()|\[\]*?])", r"\\$1")


def _glob(pattern: Column, any_char: str) -> Column:
    """Shell pattern as a regular expression; brackets pass, `[!` negates."""
    rx = F.regexp_replace(pattern, r"([\\.^$+{}()|])", r"\\$1")
    rx = F.regexp_replace(rx, r"\[(?![^\]]+\])", r"\\[")
    rx = F.regexp_replace(rx, r"\[!", "[^")
    rx = F.regexp_replace(rx, r"\*(?![^\[]*\])", any_char + "*")
    return F.regexp_replace(rx, r"\?(?![^\[]*\])", any_char)


def pattern_regex(rule: Column) -> Column:
    """What one ignore pattern matches in a path relative to its file.

    Anchored patterns match the whole path and their stars stop at `/`.
    Others match any trailing part, and there a star may cross `/`.  A `**`
    splits the pattern at its first occurrence into a literal leading folder
    and a literal ending.
    """
    pattern = rule["pattern"]
    head = F.trim(F.substring_index(pattern, "**", 1), F.lit("/"))
    tail = F.trim(F.substring(pattern, F.instr(pattern, F.lit("**")) + F.lit(2),
                              F.length(pattern)), F.lit("/"))
    spanning = F.concat(
        F.when(head == "", F.lit("")).otherwise(
            F.concat(F.lit("(?="), _quoted(head), F.lit("(?:/|\\z))"))),
        F.when(tail == "", F.lit(".*")).otherwise(
            F.concat(F.lit("(?:.*/)?"), _quoted(tail))))
    spans = F.contains(pattern, F.lit("**"))
    loose = _glob(pattern, ".")
    return (F.when(rule["anchored"],
                   F.when(spans, spanning).otherwise(_glob(pattern, "[^/]")))
            .otherwise(F.concat(F.lit("(?:.*/)?(?:"), loose,
                                F.when(spans, F.concat(F.lit("|"), spanning))
                                .otherwise(F.lit("")), F.lit(")"))))


def _runs(rules: DataFrame, name: str) -> DataFrame:
    """`base, name`: the rules of each file as runs of one sign, in order.

    A run is one flat alternation, so its depth does not grow with the file.
    """
    order = Window.partitionBy("base").orderBy("seq")
    turns = F.coalesce((F.col("negated") != F.lag("negated").over(order)).cast("int"), F.lit(0))
    numbered = rules.withColumn("turn", turns).withColumn("run", F.sum("turn").over(order))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "rx"))),
                                      lambda r: r["rx"]), "|")
    return (numbered.groupBy("base", "run", "negated").agg(
                F.concat(F.lit("(?s)\\A(?:"), joined, F.lit(")\\z")).alias("rx"))
            .groupBy("base").agg(F.array_sort(F.collect_list(F.struct("run", "negated", "rx")))
                                 .alias(name)))


def compile_ignores(ignore_files: DataFrame) -> DataFrame:
    """`base, on_file, on_dir`: per ignore file, what it says of files and dirs."""
    ready = F.transform(parse_ignore("text"), lambda r: F.struct(
        F.concat(F.lit("(?:"), pattern_regex(r), F.lit(")")).alias("rx"),
        r["negated"].alias("negated"), r["dir_only"].alias("dir_only")))
    rules = ignore_files.select("base", F.posexplode(ready).alias("seq", "rule")).select(
        "base", "seq", "rule.*")
    none = F.array().cast("array<struct<run:bigint,negated:boolean,rx:string>>")
    return (_runs(rules, "on_dir").join(_runs(rules.filter(~F.col("dir_only")), "on_file"),
                                        "base", "left")
            .select("base", F.coalesce("on_file", none).alias("on_file"), "on_dir"))


def _said(value: Column, runs: Column) -> Column:
    """What a file says of a path: true ignored, false kept, null not mentioned.

    The last run that matches decides.  regexp_extract keeps its last compiled
    pattern between rows, rlike with a non-constant pattern compiles every
    time.  Values are never empty.
    """
    def step(said: Column, run: Column) -> Column:
        hit = F.call_function("regexp_extract", value, run["rx"], F.lit(0)) != ""
        return F.when(hit, ~run["negated"]).otherwise(said)
    return F.aggregate(runs, F.lit(None).cast("boolean"), step)


def directory_chains(dirs: DataFrame, compiled: DataFrame) -> DataFrame:
    """`dir, chain`: the ignore files that speak about a directory's children.

    `closed` marks a file one of whose patterns ignores the directory or one
    above it: then no later negation in that same file can bring a child back.
    The chain is as long as the path is deep at most.
    """
    pairs = (dirs.select("dir", F.explode(P.self_and_ancestors("dir")).alias("base"))
             .join(compiled, "base"))
    rel = P.relative("dir", F.col("base"))
    above = F.concat(P.relative_ancestors(rel), F.array(rel))
    closed = F.when(F.col("dir") == F.col("base"), F.lit(False)).otherwise(
        F.exists(above, lambda p: F.coalesce(_said(p, F.col("on_dir")), F.lit(False))))
    link = F.struct(F.length("base").alias("depth"), F.col("base"),
                    closed.alias("closed"), F.col("on_file"), F.col("on_dir"))
    return pairs.groupBy("dir").agg(F.array_sort(F.collect_list(link)).alias("chain"))


def chain_verdict(path: Column, chain: Column, is_dir: Column | None = None) -> Column:
    """Fold a chain, shallow to deep; only a match moves the verdict."""
    def step(verdict: Column, link: Column) -> Column:
        rel = F.substring(path, F.length(link["base"]) + F.lit(2), F.length(path))
        if is_dir is None:
            rules = link["on_file"]
        else:
            rules = F.when(is_dir, link["on_dir"]).otherwise(link["on_file"])
        return F.when(link["closed"], F.lit(True)).otherwise(
            F.coalesce(_said(rel, rules), verdict))
    return F.coalesce(F.aggregate(chain, F.lit(False), step), F.lit(False))


def with_ignored(files: DataFrame, ignore_files: DataFrame) -> DataFrame:
    """`files` plus boolean `ignored`.  Uses `kind` for dirs when present."""
    dirs = files.select(P.dirname("path").alias("dir")).distinct()
    chains = directory_chains(dirs, compile_ignores(ignore_files))
    is_dir = (F.col("kind") == DIR) if "kind" in files.columns else None
    return (lookup(files.withColumn("dir", P.dirname("path")), chains, ["dir"])
            .withColumn("ignored", chain_verdict(F.col("path"), F.col("chain"), is_dir))
            .select(*files.columns, "ignored"))


# -- membership -------------------------------------------------------------

def members(files: DataFrame, rules: DataFrame | list[tuple[str, str]],
            root: str | None = None,
            ignore_files: DataFrame | None = None) -> DataFrame:
    """Rows in scope: an include rule covers them and no ignore file objects.

    `rules` is a table (path, mode) of any length, or a list of such pairs.
    Ignore files at or below `root` decide under `root`; elsewhere only rules.
    """
    if not isinstance(rules, DataFrame):
        rules = files.sparkSession.createDataFrame(list(dict(rules).items()),
                                                   "path string, mode string")
    chosen = (innermost_rule(files, rules.dropDuplicates(["path"]))
              .filter(F.col("mode") == INCLUDE).select(*files.columns))
    if root is None or ignore_files is None:
        return chosen
    local = ignore_files.filter(P.under("base", root))
    judged = with_ignored(chosen, local)
    return (judged.filter(~P.under("path", root) | ~F.col("ignored"))
            .select(*files.columns))


def repo_rules(root: str) -> list[tuple[str, str]]:
    root = root.rstrip("/") or "/"
    return [(root, INCLUDE), (root.rstrip("/") + "/.git", EXCLUDE)]


def in_junk(path, root: str, is_dir: Column | None = None) -> Column:
    """A directory above `path` and below `root` has a junk name.

    With `is_dir`, a directory's own name counts as well.
    """
    path = F.col(path) if isinstance(path, str) else path
    rel = P.relative(path, root)
    folders = F.when(is_dir, rel).otherwise(P.dirname(rel)) \
        if is_dir is not None else P.dirname(rel)
    return P.strictly_under(path, root) & F.arrays_overlap(
        F.split(folders, "/", -1), F.array(*[F.lit(name) for name in JUNK]))


def folder_rules(files: DataFrame, root: str) -> DataFrame:
    """Include `root`, exclude its outermost junk directories."""
    junk = (files.filter((F.col("kind") == DIR) & P.strictly_under("path", root)
                         & P.basename("path").isin(*JUNK) & ~in_junk("path", root))
            .select("path", F.lit(EXCLUDE).alias("mode")))
    return junk.unionByName(junk.sparkSession.createDataFrame(
        [(root, INCLUDE)], "path string, mode string"))


def project_kinds(projects: DataFrame, files: DataFrame) -> DataFrame:
    """Projects with `is_repo`: their `.git` directory is in the catalogue."""
    marks = (files.filter((F.col("kind") == DIR) & (P.basename("path") == ".git"))
             .select(P.dirname("path").alias("path"), F.lit(True).alias("is_repo")))
    return (projects.join(marks, "path", "left")
            .withColumn("is_repo", F.coalesce("is_repo", F.lit(False))))


def project_members(files: DataFrame, projects: DataFrame,
                    ignore_files: DataFrame) -> DataFrame:
    """`project_id, path` for every file each project's scope would take.

    A repository takes its tree without `.git`, less what its ignore files
    say; any other folder takes its tree without junk directories.
    """
    kinds = project_kinds(projects.select("project_id", "path"), files).select(
        "project_id", F.col("path").alias("root"), "is_repo")
    dirs = (files.filter(F.col("kind") == FILE)
            .select(P.dirname("path").alias("dir")).distinct())
    covered = (dirs.select("dir", F.explode(P.self_and_ancestors("dir")).alias("root"))
               .join(kinds, "root"))
    names = F.split(F.substring(F.col("dir"), F.length("root") + F.lit(2),
                                F.length("dir")), "/", -1)
    allowed = F.when(F.col("is_repo"), ~P.under("dir", F.concat("root", F.lit("/.git")))) \
        .otherwise(~F.arrays_overlap(names, F.array(*[F.lit(n) for n in JUNK])))
    covered = covered.filter(allowed)
    chains = directory_chains(dirs, compile_ignores(ignore_files))
    spoken = (covered.join(chains, "dir", "left")
              .withColumn("chain", F.when(
                  F.col("is_repo"),
                  F.filter("chain", lambda c: P.under(c["base"], F.col("root"))))))
    mine = files.filter(F.col("kind") == FILE).select("path", P.dirname("path").alias("dir"))
    return (lookup(mine, spoken, ["dir"], "inner")
            .filter(~chain_verdict(F.col("path"), F.col("chain")))
            .select("project_id", "path"))


def union_members(files: DataFrame, projects: DataFrame,
                  ignore_files: DataFrame) -> DataFrame:
    """Paths any project takes; no projects, no paths."""
    return project_members(files, projects, ignore_files).select("path").distinct()


def scope_sizes(files: DataFrame, projects: DataFrame,
                ignore_files: DataFrame) -> DataFrame:
    """In-scope files per project; NULL when the root is not catalogued."""
    counted = (project_members(files, projects, ignore_files)
               .groupBy("project_id").agg(F.count(F.lit(1)).alias("n")))
    present = (files.filter(F.col("kind") == DIR)
               .select("path", F.lit(True).alias("present")))
    return (projects.select("project_id", "path").join(present, "path", "left")
            .join(counted, "project_id", "left")
            .select("project_id", F.when(
                F.coalesce("present", F.col("n") > 0), F.coalesce("n", F.lit(0)))
                .alias("scope_size")))


def tree_states(dirs: DataFrame, rules: DataFrame,
                own: Column | None = None) -> DataFrame:
    """checked / unchecked / partial for each directory.

    Partial when any rule strictly below disagrees with the directory's own
    membership.  `own` overrides membership (for instance with ignore files);
    the default is the innermost rule.  Rules are fanned out to their
    ancestors, so the join grows with rules and not with directories.
    """
    below = (rules.select(F.explode(F.concat(F.array(F.lit("/")), P.ancestors("path")))
                          .alias("path"), (F.col("mode") == INCLUDE).alias("include"))
             .groupBy("path").agg(F.bool_or("include").alias("some_in"),
                                  F.bool_or(~F.col("include")).alias("some_out")))
    mine = own if own is not None else F.coalesce(F.col("mode") == INCLUDE, F.lit(False))
    judged = innermost_rule(dirs, rules).withColumn("mine", mine)
    disagree = F.coalesce(F.when(F.col("mine"), F.col("some_out"))
                          .otherwise(F.col("some_in")), F.lit(False))
    return judged.join(below, "path", "left").select(
        "path", F.when(disagree, F.lit(PARTIAL))
        .when(F.col("mine"), F.lit(CHECKED)).otherwise(F.lit(UNCHECKED)).alias("state"))
