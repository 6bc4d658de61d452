"""Commands over a folder of parquet layers.

A layer is written whole into a new version folder and then named by one
appended meta row, so readers see the old version or the new one and a failed
job changes nothing.  A layer that was never built refuses; it never answers
with nothing.  Parquet and the file system do the storing: there is no engine
here, and one writer at a time is assumed.
"""

from __future__ import annotations

import secrets
import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import Refused
from ..operators import (catalogue as cat, content as con, embed, equivalence as eq, freshness,
                         fusion, graph, identity, journal, scope, search, snapshots, tree)
from ..schemas import FILE, HASHED_FILES, VECTORS
from ..sources import files as readers, tree as walker

LIVING, GONE = "living", "deleted"


class Workspace:
    """One shared catalogue and any number of projects under `folder`."""

    def __init__(self, spark: SparkSession, folder: str,
                 load_model: Callable | None = None, model: str = "", dim: int = 384):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.load_model, self.model, self.dim = load_model, model, dim
        self._facts: dict[str, dict[str, str]] = {}

    # -- meta and layers ----------------------------------------------------

    def set_meta(self, store: str, **values) -> None:
        now = time.time_ns()
        rows = [(store, k, str(v), now + i) for i, (k, v) in enumerate(values.items())]
        (self.spark.createDataFrame(rows, "store string, key string, value string, seq bigint")
         .coalesce(1).write.mode("append").parquet(self.folder + "/meta"))
        if store in self._facts:
            self._facts[store].update({k: str(v) for k, v in values.items()})

    def refresh(self) -> None:
        """Forget remembered facts; another process may have written."""
        self._facts.clear()

    def meta_rows(self) -> DataFrame:
        try:
            rows = self.spark.read.parquet(self.folder + "/meta")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":  # else nothing was ever written
                raise
            return self.spark.createDataFrame([], "store string, key string, value string")
        return cat.latest_meta(rows)

    def meta(self, store: str) -> dict[str, str]:
        """The few facts of one store, read once and kept up to date by writes."""
        if store not in self._facts:
            self._facts[store] = {r["key"]: r["value"] for r in self.meta_rows().filter(
                F.col("store") == store).toLocalIterator()}
        return dict(self._facts[store])

    def has(self, store: str, layer: str) -> bool:
        return bool(self.meta(store).get("layer:" + layer))

    def read(self, store: str, layer: str) -> DataFrame:
        version = self.meta(store).get("layer:" + layer)
        if not version:  # never written, or released
            raise Refused("%s of %s was never built" % (layer, store))
        return self.spark.read.parquet(version)

    def write(self, store: str, layer: str, df: DataFrame, **facts) -> DataFrame:
        version = "%s/%s/%s/%d" % (self.folder, store, layer, time.time_ns())
        df.write.parquet(version)
        self.set_meta(store, **{"layer:" + layer: version}, **facts)
        return self.spark.read.parquet(version)

    # -- refusals -------------------------------------------------------------

    def attempt(self, command: str, action: Callable, *args, **options):
        """Run a command; a refusal is tallied as a tab-separated row and raised."""
        try:
            return action(*args, **options)
        except Refused as refusal:
            (self.spark.createDataFrame([(time.time(), command, str(refusal))],
                                        "stamp double, command string, reason string")
             .coalesce(1).write.mode("append").option("sep", "\t")
             .csv(self.folder + "/refusals"))
            raise

    def refusals(self) -> DataFrame:
        """How often each command was refused."""
        try:
            rows = self.spark.read.option("sep", "\t").schema(
                "stamp double, command string, reason string").csv(self.folder + "/refusals")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":  # else nothing was ever refused
                raise
            rows = self.spark.createDataFrame([], "stamp double, command string, reason string")
        return rows.groupBy("command").agg(F.count(F.lit(1)).alias("refused"),
                                           F.max("stamp").alias("last"))

    # -- projects -------------------------------------------------------------

    def add(self, root: str) -> str:
        root = root.rstrip("/") or "/"
        project = secrets.token_hex(8)
        here = self._root_entry(root)
        if here is None:
            raise Refused("not a directory: %s" % root)
        self.set_meta(project, project_id=project, project_path=root, state=LIVING,
                      watch=0, root_dev=here["dev"], root_inode=here["inode"])
        return project

    def _root_entry(self, root: str):
        """The root's own identity, found as an entry of its parent folder."""
        import os

        try:
            st = os.lstat(root)
        except OSError:
            return None
        return {"dev": st.st_dev, "inode": st.st_ino} if os.path.isdir(root) else None

    def projects(self) -> DataFrame:
        """`project_id, path, state, watch, root_dev, root_inode`."""
        wide = (self.meta_rows().groupBy("store")
                .pivot("key", ["project_path", "state", "watch", "root_dev", "root_inode"])
                .agg(F.first("value")).filter(F.col("project_path").isNotNull()))
        return wide.select(
            F.col("store").alias("project_id"), F.col("project_path").alias("path"), "state",
            (F.coalesce("watch", F.lit("0")) == "1").alias("watch"),
            F.col("root_dev").cast("bigint"), F.col("root_inode").cast("bigint"))

    def resolve(self, wanted: str) -> str:
        """A project by id or exact path; none or several refuse."""
        found = cat.resolve_project(self.projects(), wanted).first()
        if found["hits"] != 1:
            raise Refused("%d projects match %s" % (found["hits"], wanted))
        return found["project_id"]

    def watch(self, wanted: str, on: bool = True) -> None:
        self.set_meta(self.resolve(wanted), watch=int(on))

    # -- catalogue ------------------------------------------------------------

    def scan(self, root: str, deny: list[str] | None = None) -> dict:
        """Walk `root`, compare with the last pass, hash only what moved."""
        started = time.time()
        walked = self.write("l0", "walk", walker.walk(self.spark, root, deny))
        new = walker.entries(walked)
        if self.has("l0", "catalogue"):
            old = self.read("l0", "catalogue")
        else:
            old = self.spark.createDataFrame([], HASHED_FILES)
        living = self.projects().filter(F.col("state") == LIVING)
        ours = scope.union_members(new, living, readers.ignore_files(new))
        moved = (journal.moved(old, new).filter(F.col("kind") == FILE)
                 .join(ours, "path", "left_semi"))
        hashes = readers.hash_files(moved)
        marked = (new.join(ours.withColumn("in_scope", F.lit(True)), "path", "left")
                  .join(hashes, "path", "left")
                  .withColumn("in_scope", F.coalesce("in_scope", F.lit(False)))
                  .withColumnRenamed("digest", "hash_now"))
        lines = self.write("l0", "journal", journal.compare(old, marked))
        known = new.join(lines.select("path", "content_hash", "hash_source"), "path", "left")
        counts = walker.walk_counts(walked).first().asDict()
        self.write("l0", "catalogue", known, l0_root=root, l0_scanned_at=time.time(),
                   l0_count=counts["kept"], l0_unreadable=counts["unreadable"],
                   l0_pruned=counts["pruned"], l0_seconds="%.3f" % (time.time() - started))
        counts["journal"] = journal.tally_row(lines).first().asDict()
        return counts

    def catalogue(self) -> DataFrame:
        return self.read("l0", "catalogue")

    def _scoped(self, project: str) -> DataFrame:
        """Catalogue rows of the project's scope, decided from the tree as it is."""
        files = self.catalogue()
        mine = self.projects().filter(F.col("project_id") == project)
        taken = scope.project_members(files, mine, readers.ignore_files(files))
        return files.filter(F.col("kind") == FILE).join(
            taken.select("path"), "path", "left_semi")

    def backfill(self, max_files: int | None = None, dry_run: bool = False) -> dict:
        """Hash in-scope files that have none; the journal is left alone."""
        files = self.catalogue()
        living = self.projects().filter(F.col("state") == LIVING)
        ours = scope.union_members(files, living, readers.ignore_files(files)).withColumn(
            "ours", F.lit(True))
        marked = files.join(ours, "path", "left").withColumn(
            "ours", F.coalesce("ours", F.lit(False)))
        if max_files is not None:
            journal.refuse_over(journal.cold_rows(marked, F.col("ours")), max_files)
        if dry_run:
            return journal.cold_report(marked, F.col("ours")).first().asDict()
        hashes = readers.hash_files(journal.cold_rows(marked, F.col("ours")))
        hashes = self.write("l0", "cold_hashes", hashes)
        report = journal.backfill_report(marked, F.col("ours"), hashes).first().asDict()
        self.write("l0", "catalogue", journal.backfill(marked, F.col("ours"), hashes).drop("ours"))
        return report

    def hash_coverage(self) -> dict:
        files = self.catalogue()
        ours = scope.union_members(files, self.projects(), readers.ignore_files(files))
        marked = files.join(ours.withColumn("ours", F.lit(True)), "path", "left")
        return journal.hash_coverage(marked, F.coalesce("ours", F.lit(False))).first().asDict()

    # -- one project ------------------------------------------------------------

    def recognise(self, project: str):
        """Where the project is now: present, moved, ambiguous or deleted."""
        mine = self.projects().filter(F.col("project_id") == project)
        held = self.read(project, "content").select(
            F.lit(project).alias("project_id"),
            F.lit(self.meta(project)["project_path"]).alias("root"), "path", "size") \
            if self.has(project, "content") else self.spark.createDataFrame(
                [], "project_id string, root string, path string, size bigint")
        return identity.recognise(mine, held, self.catalogue()).first()

    def update(self, wanted: str) -> dict:
        """Content, then graph, then index: each reads the one before."""
        project = self.resolve(wanted)
        facts = self.meta(project)
        if facts.get("state") != LIVING:
            raise Refused("%s is marked deleted; restore it first" % project)
        root = facts["project_path"]
        files = self.catalogue()
        if not cat.knows(files, root):
            if self.has(project, "content"):
                now = self.recognise(project)
                if now["verdict"] != identity.PRESENT:
                    raise Refused("nothing of the project is left in %s: %s %s"
                                  % (root, now["verdict"], now["path"] or ""))
            raise Refused("no scan has covered %s yet" % root)
        layer = self.write(project, "content", con.classify(
            readers.read_bytes(self._scoped(project))))
        found = self.write(project, "links", graph.resolve(layer, root))
        edges = self.write(project, "edges", graph.edges(found))
        version = "%s/%s/index/%d" % (self.folder, project, time.time_ns())
        search.write_index(layer, version)
        tally = {r["name"]: r["n"] for r in con.tally(layer).toLocalIterator()}
        links = graph.link_tally(found).first().asDict()
        self.set_meta(project, index=version, last_update=time.time(),
                      l2_read=tally.get("read", 0), l2_unread=tally.get("unread", 0),
                      l3_edges=links["edges"], l3_ambiguous=links["ambiguous"],
                      l3_outside=links["outside"])
        return {"content": tally, "links": links, "edges": edges}

    def embed(self, wanted: str) -> dict:
        """Encode what is new, drop what has no text any more."""
        project = self.resolve(wanted)
        if self.load_model is None:
            raise Refused("no model is configured, and none is downloaded")
        facts = self.meta(project)
        embed.check_model(facts, self.model, self.dim)
        layer = self.read(project, "content")
        have = self.read(project, "vectors") if self.has(project, "vectors") \
            else self.spark.createDataFrame([], VECTORS)
        same = facts.get("embed_chunking") in (None, embed.CHUNKING)
        report = embed.maintenance_tally(embed.maintenance(
            embed.chunk_keys(layer), have, same)).first().asDict()
        self.write(project, "vectors", embed.update_vectors(
            layer, have, self.load_model, self.dim, same), embed_model=self.model,
            embed_dim=self.dim, embed_chunking=embed.CHUNKING, embed_at=time.time())
        return report

    def _query_vector(self, query: str) -> list[float]:
        if self.load_model is None:
            raise Refused("no model is configured, and none is downloaded")
        return list(self.load_model()(query))

    def _index(self, project: str) -> tuple[DataFrame, DataFrame]:
        version = self.meta(project).get("index")
        if not version:
            raise Refused("the search index was never built; update first")
        return (self.spark.read.parquet(version + "/postings"),
                self.spark.read.parquet(version + "/lengths"))

    def search(self, query: str, project: str | None = None, names: bool = False,
               semantic: bool = False, fused: bool = False) -> DataFrame:
        """Names over the catalogue, or words, meaning or both in one project."""
        if names + semantic + fused > 1:
            raise Refused("pick one of names, semantic and fused")
        if names:
            return cat.name_search(self.catalogue(), query)
        if project is None:
            raise Refused("which project?")
        project = self.resolve(project)
        layer = self.read(project, "content")
        if not semantic:
            postings, lengths = self._index(project)
            state = search.index_state(layer, lengths).first()
            if state["state"] != "ok":
                raise Refused("the search index is %s (%d of %d rows)" % tuple(state))
        if semantic or fused:
            vectors = self.read(project, "vectors")
            embed.check_model(self.meta(project), self.model, self.dim)
            if embed.check_dim(vectors, self.dim).limit(1).count():
                raise Refused("some vectors do not have %d values" % self.dim)
            if not self.embedding_coverage(project)["embedded"]:
                raise Refused("nothing is embedded in this project yet")
            asked = self._query_vector(query)
        if semantic:
            return embed.search(vectors, layer, asked)
        if not fused:
            return search.search_index(postings, lengths, query)
        words = search.search_index(postings, lengths, query, fusion.DEPTH).select(
            F.lit("lexical").alias("list"), "path", F.col("rank").alias("order"))
        meaning = embed.search(vectors, layer, asked, fusion.DEPTH).select(
            F.lit("vector").alias("list"), "path", (-F.col("score")).alias("order"))
        ranked = fusion.positions(words.unionByName(meaning), ["list"],
                                  [F.col("order"), F.col("path")])
        return fusion.top(fusion.fuse(ranked))

    def embedding_coverage(self, wanted: str) -> dict:
        project = self.resolve(wanted)
        have = self.read(project, "vectors") if self.has(project, "vectors") \
            else self.spark.createDataFrame([], VECTORS)
        return embed.coverage(embed.chunk_keys(self.read(project, "content")), have) \
            .first().asDict()

    def states(self, wanted: str) -> DataFrame:
        project = self.resolve(wanted)
        have = self.read(project, "vectors") if self.has(project, "vectors") \
            else self.spark.createDataFrame([], VECTORS)
        files = self.catalogue() if self.has("l0", "catalogue") else None
        return freshness.per_file(self.read(project, "content"), files, have)

    def stale(self, wanted: str, everything: bool = False) -> DataFrame:
        """Directories that are behind, worst first, with a line each."""
        project = self.resolve(wanted)
        root = self.meta(project)["project_path"]
        layer = self.read(project, "content")
        lines = self.read("l0", "journal").join(
            self._scoped(project).select("path"), "path", "left_semi")
        pending = freshness.pending_by_dir(lines, self.catalogue(), layer)
        rows = freshness.per_dir(self.states(project), pending)
        if not everything:
            rows = rows.filter((F.col("not_fresh") > 0) | (F.col("pending") > 0))
        return freshness.worst_first(rows).withColumn("line", freshness.describe_dir(root))

    def ages(self, wanted: str) -> DataFrame:
        project = self.resolve(wanted)
        mine, shared = self.meta(project), self.meta("l0")
        stamps = self.spark.createDataFrame(
            [(project, shared.get("l0_scanned_at"), mine.get("last_update"),
              mine.get("embed_at"))],
            "store string, catalogue string, content string, vectors string")
        return freshness.layer_ages(stamps, F.lit(time.time()))

    def status(self, wanted: str) -> dict:
        """Every layer with what it holds, and what is missing by name."""
        project = self.resolve(wanted)
        out = {"project": project, **self.meta(project)}
        if not self.has(project, "content"):
            return {**out, "content": "not built"}
        layer = self.read(project, "content")
        out["tally"] = {r["name"]: r["n"] for r in con.tally(layer).toLocalIterator()}
        out["freshness"] = freshness.tally(self.states(project)).first().asDict()
        lengths = self._index(project)[1] if out.get("index") else None
        out["index"] = search.index_state(layer, lengths).first().asDict()
        out["embedded"] = self.embedding_coverage(project)
        out["in_scope"] = scope.scope_sizes(
            self.catalogue(), self.projects().filter(F.col("project_id") == project),
            readers.ignore_files(self.catalogue())).first()["scope_size"]
        out["hashes"] = self.hash_coverage()
        out["ages"] = self.ages(project).first()["line"]
        return out

    def overview(self) -> DataFrame:
        """Every project with its state, the layers it has and when it was last updated."""
        held = F.when(F.startswith("key", F.lit("layer:")) & (F.col("value") != ""), F.substring("key", 7, 64))
        facts = self.meta_rows().groupBy("store").agg(
            F.array_sort(F.collect_set(held)).alias("layers"),
            F.max(F.when(F.col("key") == "last_update", F.col("value").cast("double"))).alias("last_update"))
        return (self.projects().join(facts.withColumnRenamed("store", "project_id"), "project_id", "left")
                .select("project_id", "path", "state", "watch", "layers", "last_update").orderBy("path", "project_id"))

    def neighbours(self, wanted: str, node: str, hops: int = 1):
        start = self.spark.createDataFrame([(node,)], "node string")
        reached, used = graph.neighbours(self.read(self.resolve(wanted), "edges"), start, hops)
        return reached.orderBy("node"), used, graph.provenance(used)

    def view(self, wanted: str, out: str) -> DataFrame:
        """Nodes and edges as JSON lines under `out`; returns the tally."""
        project = self.resolve(wanted)
        root = self.meta(project)["project_path"]
        if out.rstrip("/") == root or out.startswith(root.rstrip("/") + "/"):
            raise Refused("the view may not be written into its own source")
        states = self.states(project)
        if states.isEmpty():
            raise Refused("the project has no content yet")
        nodes, edges = tree.nodes(states, root), tree.edges(states, root)
        nodes.orderBy("id").write.mode("overwrite").json(out + "/nodes")
        edges.orderBy("from", "to").write.mode("overwrite").json(out + "/edges")
        self.ages(project).write.mode("overwrite").json(out + "/ages")
        return tree.tally(nodes)

    # -- moves, snapshots, equivalence --------------------------------------------

    def apply_move(self, wanted: str, new_root: str) -> None:
        """Point the project at its new place; hashes and edges stay."""
        project = self.resolve(wanted)
        old = self.meta(project)["project_path"]
        here = self._root_entry(new_root)
        if here is None:
            raise Refused("not a directory: %s" % new_root)
        self.write(project, "content", con.move_paths(self.read(project, "content"), old, new_root),
                   project_path=new_root, root_dev=here["dev"], root_inode=here["inode"])

    def mark_deleted(self, wanted: str) -> None:
        self.set_meta(self.resolve(wanted), state=GONE)

    def snapshot(self, wanted: str) -> str:
        """Freeze the current layers: their versions are immutable already.

        Rows and digest of each are written down, then everything is read
        again against them.
        """
        project = self.resolve(wanted)
        name = "%s@%d" % (project, time.time_ns())
        current = self.meta(project)
        try:
            seen = {"digest:" + k: snapshots.digest(self.spark.read.parquet(v)) for k, v in self._tables(current)}
        except snapshots.FAILURES as problem:
            if not snapshots.is_damage(problem):
                raise
            raise Refused("snapshot stopped at the take step: a layer does not read") from problem
        self.set_meta("snapshot:" + name, of=project, taken_at=time.time(), **seen, **{
            "was:" + k: v for k, v in current.items()})
        if not self.verify(name, project, current["project_path"]):
            self.set_meta("snapshot:" + name, dropped=1)
            raise Refused("snapshot stopped at the verify step: it did not read back as this project")
        return name

    def _tables(self, facts: dict[str, str]) -> list[tuple[str, str]]:
        """(name, folder) of all tables that facts point at, those of the index too."""
        out = [(k, v) for k, v in facts.items() if k.startswith("layer:") and v]
        if facts.get("index"):
            out += [("index:" + part, facts["index"] + "/" + part) for part in ("postings", "lengths")]
        return out

    def verify(self, name: str, project: str, path: str) -> bool:
        """All tables of a snapshot read back with the rows and digests that were written down.

        False if a file is gone or does not read, or if other rows are in it.
        Whatever else stops a job is raised: a lost executor damages nothing.
        """
        facts = self.meta("snapshot:" + name)
        was = {k[4:]: v for k, v in facts.items() if k.startswith("was:")}
        if was.get("project_id") != project or was.get("project_path") != path:
            return False
        try:
            return all(snapshots.digest(self.spark.read.parquet(v)) == facts.get("digest:" + k)
                       for k, v in self._tables(was))
        except snapshots.FAILURES as problem:
            if not snapshots.is_damage(problem):
                raise
            return False

    def retire(self, wanted: str) -> str:
        """Take, verify, then release: only what reads back lets go of the living layers.

        A refusal names the step that stopped; until the last one the project
        is as it was.  `restore` brings it back.
        """
        project = self.resolve(wanted)
        name = self.snapshot(project)
        points = [k for k in self.meta(project) if k.startswith("layer:") or k == "index"]
        self.set_meta(project, state=GONE, **dict.fromkeys(points, ""))
        return name

    def free(self) -> list[str]:
        """Remove every stored version that no living pointer and no kept snapshot names.

        Files are listed and compared as rows; one folder is removed per
        version.  Rows that were read from such a version before, and are
        computed later, are gone with it.
        """
        self.refresh()
        if not self._facts_written():
            return []
        stored = (self.spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                  .load(self.folder + "/*/*/*").select("path"))
        gone = [r["version"] for r in snapshots.unnamed_versions(stored, self.meta_rows()).toLocalIterator()]
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for version in gone:
            path = hadoop.Path(self.folder + "/" + version)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return sorted(gone)

    def _facts_written(self) -> bool:
        """Some pointer was ever written, so there are versions to list."""
        return not self.meta_rows().filter(F.startswith("key", F.lit("layer:"))).isEmpty()

    def snapshots(self) -> DataFrame:
        """`project_id, snapshot_id, taken_at, living` of every snapshot."""
        rows = self.meta_rows()
        wide = (rows.filter(F.startswith("store", F.lit("snapshot:")))
                .groupBy("store").pivot("key", ["of", "taken_at", "dropped"])
                .agg(F.first("value")).filter(F.col("dropped").isNull()))
        state = rows.filter(F.col("key") == "state").select(
            F.col("store").alias("project_id"), (F.col("value") == LIVING).alias("living"))
        return wide.select(
            F.col("of").alias("project_id"), F.substring("store", 10, 1 << 20).alias("snapshot_id"),
            F.timestamp_seconds(F.col("taken_at").cast("double")).alias("taken_at")).join(
            state, "project_id", "left").withColumn("living", F.coalesce("living", F.lit(False)))

    def apply_retention(self, now: float | None = None) -> list[str]:
        """Forget snapshots outside the window, and free what nothing names then."""
        at = F.timestamp_seconds(F.lit(time.time() if now is None else now))
        gone = [r["snapshot_id"] for r in snapshots.retention(self.snapshots(), at)
                .filter(~F.col("keep")).select("snapshot_id").toLocalIterator()]
        for name in gone:
            self.set_meta("snapshot:" + name, dropped=1)
        self.free()
        return gone

    def expiring(self, now: float | None = None) -> DataFrame:
        return snapshots.expiring(self.snapshots(), F.timestamp_seconds(
            F.lit(time.time() if now is None else now)))

    def restore(self, wanted: str) -> str:
        """The newest snapshot that verifies becomes the project again."""
        import os

        names = [r["snapshot_id"] for r in self.snapshots()
                 .filter(F.col("project_id") == wanted).orderBy(F.desc("taken_at"))
                 .select("snapshot_id").toLocalIterator()]
        for name in names:
            facts = self.meta("snapshot:" + name)
            path = facts.get("was:project_path", "")
            if self.verify(name, wanted, path):
                if not os.path.isdir(path):
                    raise Refused("%s does not exist, bring it back first" % path)
                self.set_meta(wanted, **{k[4:]: v for k, v in facts.items()
                                         if k.startswith("was:")})
                self.set_meta(wanted, state=LIVING)
                return name
        raise Refused("no snapshot of %s reads back" % wanted)

    def store_layers(self, wanted: str) -> dict[str, DataFrame]:
        """What two projects are compared on."""
        project = self.resolve(wanted)
        out = {n: self.read(project, n) for n in ("content", "edges", "vectors")
               if self.has(project, n)}
        out["meta"] = self.meta_rows().filter(
            (F.col("store") == project) & ~F.startswith("key", F.lit("layer:"))
            & (F.col("key") != "index")).select("key", "value")
        return out

    def differences(self, left: str, right: str) -> DataFrame:
        return eq.differences(self.store_layers(left), self.store_layers(right))
