"""From files to live facts, and from documents to linked chunks, over a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from collections.abc import Callable

from ..functions.text import slugify
from ..sources import documents, sheets
from . import agreement, gates, ingest, mapper, reconcile, text, totals, validate
from .derive import derive
from .store import Clash, Store, conform, move, numbered, rows_in, scratch
from .tools import Tools


class Engine:
    """One store. policy: how conflicts are decided (first, prefer, open, ranked by source within the metric's band); gate: who lets facts go live; ask: a mapper for headers that no rule knows.

    Whatever changes the store is one load of it (see Store): it counts as a whole or not at all, and one that clashes
    with another is done again. Facts of a file count from when its gate has said yes.
    """

    #: How often a load is done again that has clashed with others.
    ATTEMPTS = 5

    def __init__(self, spark: SparkSession, path: str, *, compat: bool = False, policy: str = "first", prefer: str | None = None, gate: gates.Policy = gates.accept, ask: Callable | None = None) -> None:
        self.spark, self.store, self.compat, self.policy, self.prefer, self.gate, self.ask = spark, Store(spark, path), compat, policy, prefer, gate, ask

    def _once(self, work: Callable[[Store], dict], nothing: dict, name: str | None = None) -> dict:
        """What work returns, after its load has been committed; nothing, if a load of this name was before."""
        for attempt in range(self.ATTEMPTS):
            load = self.store.begin(name)
            if load is None:
                return nothing
            try:
                out = work(load)
                load.commit()
                return out
            except Clash:
                if attempt == self.ATTEMPTS - 1:
                    raise
        raise AssertionError

    def load_folder(self, folder: str) -> dict:
        return self.load(sheets.list_files(self.spark, folder))

    def _register(self, load: Store, files: DataFrame, names: DataFrame, state: str) -> DataFrame:
        """source_files rows for new files (file_id, path, filename, file_type, checksum) with their entities, new ones made. Returns those of this load."""
        known = load.read("entities")
        wanted = scratch(names.select("file_id", "entity_name", slugify(F.col("entity_name")).alias("entity_slug")), "names")
        new = scratch(wanted.groupBy("entity_slug").agg(F.min("entity_name").alias("entity_name")).join(known.select("entity_slug"), "entity_slug", "left_anti"), "entities")
        if rows_in(new):
            new = numbered(new, ["entity_slug"], "entity_id", load.reserve("entity_id", rows_in(new)))
            load.append("entities", new.withColumn("created_at", F.current_timestamp()))
        rows = files.join(wanted.join(load.read("entities").select("entity_slug", "entity_id"), "entity_slug"), "file_id")
        rows = rows.select("file_id", "entity_id", "filename", F.col("path").alias("file_path"), "file_type", "checksum", "detected_unit", F.lit(state).alias("state"), F.current_timestamp().alias("ingested_at"))
        rows = scratch(rows, "registered")
        load.append("source_files", rows)
        return rows

    def _numbered(self, load: Store, files: DataFrame) -> DataFrame | None:
        """The files whose content is not known yet, with file_id in order of path; None if there are none."""
        known = load.read("source_files").where("state <> 'RESET'")  # what was reset may come again
        fresh = scratch(sheets.new_files(files.drop("content"), known).select("path", "checksum"), "fresh")
        if not rows_in(fresh):
            return None
        numbers = numbered(fresh, ["path", "checksum"], "file_id", load.reserve("file_id", rows_in(fresh))).select("path", "checksum", "file_id")
        return files.join(numbers.withColumn("file_id", F.col("file_id").cast("int")), ["path", "checksum"])

    def _staged(self, load: Store, facts: DataFrame, registered: DataFrame) -> int:
        """Write staged facts and count them."""
        facts = scratch(facts, "facts")
        first = load.reserve("staging_id", rows_in(facts))
        return load.append("staging_facts", ingest.stage(facts, registered, first - 1).withColumn("created_at", F.current_timestamp()))

    @staticmethod
    def _whole(parts: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame, dict]:
        """parts and files without the files that could not be read, also without what they gave before they failed; and the errors of those."""
        if not rows_in(parts, "broken"):
            return parts, fresh, {}
        broken = parts.where("error IS NOT NULL").select("file_id", "error")
        parts, fresh = (x.join(broken, "file_id", "left_anti") for x in (parts, fresh))
        return parts, scratch(fresh, "files"), {r["file_id"]: r["error"] for r in broken.collect()}

    def load(self, files: DataFrame, name: str | None = None) -> dict:
        """Load files that are new, reconcile, validate, ask the gate, promote and derive their entities. Returns counts.

        name: of a load that must not be done twice, whatever its files (a batch of a stream). Files that cannot be read
        are reported, and neither they nor entities that only they have are stored.
        """
        nothing = {"files": 0, "staged": 0, "conflicts": 0, "live": 0, "issues": 0}

        def work(load: Store) -> dict:
            fresh = self._numbered(load, files)
            if fresh is None:
                return nothing
            grid = scratch(sheets.read_grid(fresh), "grid", broken=F.col("error").isNotNull())  # every file is parsed once
            fresh = scratch(fresh.drop("content"), "files")
            grid, fresh, errors = self._whole(grid, fresh)
            if not rows_in(fresh):
                return nothing | {"errors": errors}
            about = scratch(ingest.discover(grid.drop("error")), "sheets")
            unit = about.groupBy("file_id").agg(F.min_by("unit", "sheet").alias("detected_unit"))
            names = ingest.entity_names(about, fresh.select("file_id", "filename"))
            registered = self._register(load, fresh.join(unit, "file_id", "left"), names, "AWAITING_ACKNOWLEDGMENT")
            table = scratch(ingest.cells(grid.drop("error"), about), "cells", far=F.col("row_idx") >= totals.PART)
            if self.ask:
                mapper.map_headers(self.store, ingest.unmapped(table, compat=self.compat), self.ask)
            facts = ingest.extract(table, about.select("file_id", "sheet", "unit"), compat=self.compat)
            staged = self._staged(load, facts, registered)
            notes = ingest.annotations(table).join(registered.select("file_id", "entity_id"), "file_id")
            load.append("qualitative_chunks", notes.withColumn("chunk_id", F.xxhash64("file_id", "sheet", "chunk_index", "raw_text")))
            log = fresh.select("file_id", F.lit("loaded").alias("event"), F.col("filename").alias("detail"))
            names = scratch(totals.labelled(table, compat=self.compat), "total-names")
            if rows_in(names):
                whole = not rows_in(table, "far")
                checked = totals.check(totals.marked(table, whole=whole), whole=whole).join(names, "label", "left_semi")
                log = log.unionByName(totals.log(checked))
            logged = load.append("ingestion_log", log.withColumn("logged_at", F.current_timestamp()).withColumn("log_id", F.xxhash64("file_id", "event", "detail")))
            return {"files": rows_in(fresh), "errors": errors, "staged": staged, "totals_off": logged - rows_in(fresh)} | self._reconcile(load, registered.select("file_id"))

        return self._once(work, nothing, name)

    def reconcile(self, file_ids: list[int]) -> dict:
        """Ask the gate again about files that wait for it: conflicts, validation, promotion and derivation of their entities."""
        ids = self.spark.createDataFrame([(i,) for i in file_ids], "file_id int")
        return self._once(lambda load: self._reconcile(load, ids), {})

    def reject(self, file_ids: list[int]) -> None:
        """Files that wait for the gate are refused for good, until reconcile() asks again."""
        ids = self.spark.createDataFrame([(i,) for i in file_ids], "file_id int")
        self._once(lambda load: self._state(load, ids, "REJECTED") or {}, {})

    def _reconcile(self, load: Store, ids: DataFrame) -> dict:
        """Conflicts, validation, gate, promotion and derivation for the entities of these files (file_id); live facts are computed anew from all that the gate has let in."""
        files = load.read("source_files")
        mine = scratch(files.join(ids, "file_id", "left_semi").select("file_id", "entity_id", "state"), "mine", other=F.col("state") != "AWAITING_ACKNOWLEDGMENT")
        if rows_in(mine, "other"):
            self._state(load, mine.where("state <> 'AWAITING_ACKNOWLEDGMENT'").select("file_id"), "AWAITING_ACKNOWLEDGMENT")
        entities = mine.select("entity_id").distinct()
        let_in = files.where("state = 'LIVE'").select("file_id").unionAll(mine.select("file_id"))
        staging = scratch(self._let_in(load, entities, let_in), "staging")
        conflicts, decisions, rows = self._decided(load, staging, files)
        issues = scratch(validate.validate(staging, live=load.read("live_facts").join(entities, "entity_id", "left_semi")), "issues")
        out = {"conflicts": rows_in(conflicts), "issues": rows_in(issues), "live": 0}
        staged = staging.join(mine.select("file_id"), "file_id", "left_semi")
        if not gates.proceed_despite(issues, self.gate) or not gates.onboard(staged, load.read("source_files").join(ids, "file_id", "left_semi"), rows, self.gate):
            return out
        load.overwrite("conflicts", rows, entities)
        live = self._promote(load, staging, decisions, entities)
        self._state(load, mine.select("file_id"), "LIVE")
        return out | {"live": live}

    @staticmethod
    def _let_in(load: Store, entities: DataFrame, files: DataFrame) -> DataFrame:
        """Staged facts of entities that come from these files."""
        return load.read("staging_facts").join(entities, "entity_id", "left_semi").join(files, "file_id", "left_semi")

    def _decided(self, load: Store, staging: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Conflicts of staged facts, what is decided of them (by users first, then by the policy), and both as rows of the store's conflicts."""
        conflicts = scratch(reconcile.detect_conflicts(staging, files), "conflicts")
        made = agreement.decide(staging, files) if self.policy == "ranked" else reconcile.resolve(conflicts, self.policy, self.prefer)
        decisions = scratch(reconcile.settled(made, load.read("resolutions")), "decisions")
        joined = conflicts.join(decisions, reconcile.KEY).withColumnRenamed("options", "values_seen").withColumn("resolved_by", F.coalesce("resolved_by", F.lit(self.policy)))
        rows = joined.withColumn("conflict_id", F.xxhash64(*reconcile.KEY)).withColumn("resolved_at", F.when(F.col("state") == "RESOLVED", F.current_timestamp()))
        return conflicts, decisions.drop("resolved_by"), rows

    def _promote(self, load: Store, staging: DataFrame, decisions: DataFrame, entities: DataFrame) -> int:
        """Live facts of entities, reported and derived, in place of those that they had."""
        slugs = load.read("entities").select("entity_id", "entity_slug")
        reported = scratch(reconcile.promote(staging, decisions, slugs, compat=self.compat), "reported")
        made = derive(reported, replace_reported=self.compat)
        both = conform(reported, "live_facts").unionByName(conform(made, "live_facts"))
        if self.compat:
            both = both.where("NOT is_derived").join(made.select("fact_id"), "fact_id", "left_anti").unionByName(conform(made, "live_facts"))
        return load.overwrite("live_facts", both.withColumn("created_at", F.current_timestamp()).withColumn("updated_at", F.current_timestamp()), entities)

    def _again(self, load: Store, entities: DataFrame) -> None:
        """Conflicts and live facts of entities, from the files that are live."""
        files = load.read("source_files")
        staging = scratch(self._let_in(load, entities, files.where("state = 'LIVE'").select("file_id")), "staging")
        _, decisions, rows = self._decided(load, staging, files)
        load.overwrite("conflicts", rows, entities)
        self._promote(load, staging, decisions, entities)

    def resolve_conflict(self, conflict_id: int, staging_id: int, by: str = "user") -> None:
        """A user's word on one conflict: which staged fact holds. It outlives later loads; the entity's live facts follow at once."""

        def work(load: Store) -> dict:
            found = load.read("conflicts").where(F.col("conflict_id") == conflict_id).limit(1).collect()
            if not found:
                raise ValueError(f"no conflict {conflict_id}")
            if staging_id not in found[0]["staging_ids"]:
                raise ValueError(f"{staging_id} is none of {found[0]['staging_ids']}")
            key = [found[0][k] for k in reconcile.KEY]
            said = self.spark.createDataFrame([(*key, staging_id, by)], "entity_id int, canonical_field string, period string, resolution_staging_id long, resolved_by string")
            load.log("resolutions", said.withColumn("resolved_at", F.current_timestamp()))
            self._again(load, said.select("entity_id"))
            return {}

        self._once(work, {})

    @staticmethod
    def _state(load: Store, ids: DataFrame, state: str) -> None:
        """Move files (file_id) on; each step is an appended row, and one that STATES does not allow raises."""
        files = load.read("source_files").join(ids, "file_id", "left_semi")
        load.log("file_states", move(files, state, F.lit(True)).select("file_id", "state", F.current_timestamp().alias("moved_at")))

    def load_documents(self, files: DataFrame, encoder=None) -> dict:
        """Word files: structured tables become facts of their entities, the rest chunks with claims, links and vectors. A file that cannot be read is reported and left out."""
        nothing = {"files_processed": 0, "chunks_total": 0, "errors": {}}

        def work(load: Store) -> dict:
            fresh = self._numbered(load, files)
            if fresh is None:
                return nothing
            read = scratch(documents.read_parts(fresh), "parts", broken=F.col("error").isNotNull())
            fresh = scratch(fresh.drop("content").withColumn("detected_unit", F.lit(None).cast("string")), "files")
            read, fresh, errors = self._whole(read, fresh)
            if not rows_in(fresh):
                return nothing | {"errors": errors}
            read = read.drop("error")
            body = documents.paragraphs(read)
            long = body.withColumn("key", F.struct("file_id", "chunk_index", "region_type", "chunk_type", "section_path").cast("string"))
            split = text.chunk_documents(long, key="key", text="raw_text").withColumnRenamed("chunk_index", "part").drop("section_path")
            body = long.drop("raw_text").join(split, "key").select("file_id", "chunk_index", "part", "region_type", "chunk_type", "section_path", "raw_text")
            other = documents.table_chunks(read).select("file_id", "chunk_index", F.lit(0).alias("part"), "region_type", "chunk_type", "section_path", "raw_text")
            return self._documents(load, fresh, body.union(other), documents.table_grid(read), encoder) | {"errors": errors}

        return self._once(work, nothing)

    def load_pages(self, blocks: DataFrame, files: DataFrame, encoder=None) -> dict:
        """Page blocks (path, page, x0, y0, x1, y1, text, page_height), as any reader of pages gives them, of files (path, filename, file_type, checksum): chunks like those of documents."""
        nothing = {"files_processed": 0, "chunks_total": 0, "errors": {}}

        def work(load: Store) -> dict:
            fresh = self._numbered(load, files)
            if fresh is None:
                return nothing
            fresh = scratch(fresh.withColumn("detected_unit", F.lit(None).cast("string")), "files")
            rows = documents.block_chunks(blocks.join(fresh.select("path", "file_id"), "path"))
            nth = F.row_number().over(Window.partitionBy("file_id").orderBy("page", "y0", "raw_text")) - 1
            chunks = rows.select("file_id", nth.alias("chunk_index"), F.lit(0).alias("part"), "region_type", "chunk_type", "section_path", "raw_text")
            return self._documents(load, fresh, chunks, self.spark.createDataFrame([], "file_id int, sheet string, row_idx int, col_idx int, raw string"), encoder) | {"errors": {}}

        return self._once(work, nothing)

    def _documents(self, load: Store, fresh: DataFrame, chunks: DataFrame, grid: DataFrame, encoder) -> dict:
        """Register documents, promote the facts of their tables, and link their chunks to what is live then."""
        none = self.spark.createDataFrame([], "file_id int, sheet string, preamble array<string>")
        names = ingest.same_names(ingest.entity_names(none, fresh.select("file_id", "filename")), load.read("entities"))
        registered = self._register(load, fresh, names, "PROCESSING")
        ids, entities = registered.select("file_id"), registered.select("entity_id").distinct()
        if grid.limit(1).count():
            about = ingest.discover(grid)
            facts = ingest.extract(ingest.cells(grid, about), about.select("file_id", "sheet", F.lit("INR absolute").alias("unit")), compat=self.compat)
            self._staged(load, facts, registered)
        self._state(load, ids, "LIVE")
        self._again(load, entities)
        found = text.with_claims(chunks.join(registered.select("file_id", "entity_id"), "file_id"))
        linked = text.link_to_facts(found, load.read("live_facts").join(entities, "entity_id", "left_semi"))
        rows = linked.withColumn("embedding", text.embed(F.col("raw_text"), encoder)).withColumn("chunk_id", F.xxhash64("file_id", "region_type", "chunk_index", "part"))
        about = F.create_map(*[x for c in ("region_type", "chunk_type", "section_path") for x in (F.lit(c), F.col(c))])
        n = load.append("qualitative_chunks", rows.withColumn("metadata", about).withColumn("created_at", F.current_timestamp()))
        return {"files_processed": rows_in(fresh), "chunks_total": n}

    def reset(self, entity_id: int) -> None:
        """Take an entity's files out of sight, with their facts, conflicts and chunks; the files may be loaded again."""

        def work(load: Store) -> dict:
            self._state(load, load.read("source_files").where((F.col("entity_id") == entity_id) & (F.col("state") == "LIVE")).select("file_id"), "RESET")
            return {}

        self._once(work, {})

    def report(self) -> str:
        """What is live, by entity: files by state, facts by metric, open conflicts."""
        files = gates.entity_overview(self.store.read("entities"), self.store.read("source_files"))
        live = self.store.read("live_facts").groupBy("entity_id").agg(F.count("*").alias("facts"), F.count_if("is_derived").alias("derived"), F.count_distinct("canonical_field").alias("metrics"))
        open_ = self.store.read("conflicts").groupBy("entity_id").agg(F.count("*").alias("conflicts"), F.count_if(F.col("state") == "OPEN").alias("open"))
        rows = files.join(live, "entity_id", "left").join(open_, "entity_id", "left").na.fill(0).orderBy("entity_name").collect()
        return "\n".join(f"{r['entity_name']}: {r['live_files']} of {r['files']} files live, {r['facts']} facts ({r['derived']} derived) of {r['metrics']} metrics, {r['conflicts']} conflicts ({r['open']} open)" for r in rows)

    def tools(self, encoder: Callable | None = text.hashed_words) -> Tools:
        """Tools over the store; encoder: what the chunks' vectors were made with, None to search by words."""
        return Tools(self.store.read("live_facts"), self.store.read("source_files"), self.store.read("entities"), self.store.read("qualitative_chunks"), encoder, compat=self.compat, staging=self.store.read("staging_facts"), conflicts=self.store.read("conflicts"))
