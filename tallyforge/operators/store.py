"""Tables of the fact store, the journal of loads that makes their rows visible, and how both are written.

Whatever a load writes, into whichever tables, lies in folders of its own (load_id=...) and is out of sight until the
load is committed: one small file in the journal, put there by a rename that fails if its place is taken. A load that
fails midway therefore leaves nothing that anybody reads, and is simply done again; the rest is cleared by vacuum().
"""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

VALUE = "decimal(28,6)"

SCHEMAS = {
    "entities": "entity_id int, entity_name string, entity_slug string, aliases array<string>, created_at timestamp",
    "source_files": "file_id int, entity_id int, filename string, file_path string, file_type string, checksum string, detected_unit string, confirmed_unit string, sheet_name string, state string, ingested_at timestamp, live_at timestamp",
    "schema_mappings": "mapping_id long, file_id int, raw_header string, canonical_field string, confidence double, mapped_by string, created_at timestamp",
    "staging_facts": f"staging_id long, file_id int, entity_id int, canonical_field string, period string, value_normalised {VALUE}, currency string, original_unit string, conversion_factor double, conversion_applied boolean, raw_value double, raw_header string, row_context string, cell_reference string, source_sheet string, created_at timestamp",
    "live_facts": f"fact_id string, entity_id int, entity_slug string, canonical_field string, period string, value_normalised {VALUE}, currency string, original_unit string, conversion_factor double, conversion_applied boolean, source_file_id int, staging_id long, cell_reference string, source_sheet string, is_derived boolean, derived_from array<string>, authoritative_note string, created_at timestamp, updated_at timestamp",
    "conflicts": "conflict_id long, entity_id int, canonical_field string, period string, staging_ids array<long>, values_seen array<struct<staging_id: long, value: string, source: string>>, resolution_staging_id long, resolved_by string, resolved_at timestamp, state string",
    "ingestion_log": "log_id long, file_id int, event string, detail string, logged_at timestamp",
    "file_states": "file_id int, state string, nth long, moved_at timestamp",
    "resolutions": "entity_id int, canonical_field string, period string, resolution_staging_id long, resolved_by string, nth long, resolved_at timestamp",
    "header_cache": "header_key string, raw_header string, canonical_field string, confidence string, needs_review boolean, reasoning string, nth long, created_at timestamp",
    "qualitative_chunks": "chunk_id long, file_id int, entity_id int, chunk_index int, region_type string, chunk_type string, section_path string, linked_fact_ids array<string>, linked_periods array<string>, linked_metrics array<string>, contains_numerical_claim boolean, numerical_claims array<struct<number: string, type: string, context: string>>, raw_text string, embedding array<float>, metadata map<string, string>, created_at timestamp",
    "replaced": "table_name string, key string",
}

#: States of a file, and where each may go.
STATES = {
    "UPLOADED": {"SCHEMA_MAPPED", "REJECTED"},
    "SCHEMA_MAPPED": {"AWAITING_CONFLICT_RESOLUTION", "AWAITING_ACKNOWLEDGMENT"},
    "AWAITING_CONFLICT_RESOLUTION": {"AWAITING_ACKNOWLEDGMENT"},
    "AWAITING_ACKNOWLEDGMENT": {"LIVE", "REJECTED"},
    "REGISTERED": {"PROCESSING"},
    "PROCESSING": {"AWAITING_ACKNOWLEDGMENT", "LIVE", "REJECTED"},
    "LIVE": {"RESET"},
    "RESET": {"UPLOADED"},
    "REJECTED": {"AWAITING_ACKNOWLEDGMENT"},
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with the columns and types of a table; columns that it lacks are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table)])


_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, for what is written between steps; a local one only if they are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="facts-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def scratch(df: DataFrame, what: str, **counts: Column) -> DataFrame:
    """df, written once to the shared folder and read again, so that what follows neither computes it anew nor loses it with an executor.

    Rows are counted while they are written, as are those that meet the conditions in counts: see rows_in.
    """
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in counts.items()]).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    try:
        out._counted = seen.get
    except Py4JJavaError:  # Spark drops what observes a plan that turns out to be empty
        out._counted = {"rows": out.count()} | {n: out.where(c).count() for n, c in counts.items()}
    return out


def rows_in(df: DataFrame, which: str = "rows") -> int:
    """Rows of what scratch() wrote, without a job."""
    return df._counted[which]


def if_small(df: DataFrame, most_rows: int = 500_000) -> DataFrame:
    """A side of a join, to be broadcast only if it has at most so many rows; counted, unless it was when it was written."""
    n = rows_in(df) if hasattr(df, "_counted") else df.limit(most_rows + 1).count()
    return F.broadcast(df) if n <= most_rows else df


def numbered(rows: DataFrame, by: list[str], name: str, first: int) -> DataFrame:
    """Rows that scratch() wrote with first, first + 1, ... in order of by: few at once; many are dealt by ranges, and numbered within a range after the sizes of those before it."""
    if rows_in(rows) <= 100_000:
        return rows.withColumn(name, F.lit(first - 1) + F.row_number().over(Window.orderBy(*by)))
    dealt = scratch(rows.repartitionByRange(*by).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    nth = F.row_number().over(Window.partitionBy("__range").orderBy(*by))
    out = dealt.join(F.broadcast(sizes.select("__range", before.alias("__before"))), "__range")
    return out.withColumn(name, F.lit(first - 1) + F.col("__before") + nth).drop("__range", "__before")


def latest(rows: DataFrame, *key: str) -> DataFrame:
    """Of rows that were appended one after another (nth) the last for each key."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), "nth").alias("last")).select(*key, "last.*")


class Clash(Exception):
    """Another load has been committed meanwhile that loaded the same files or entities."""


class Store:
    """Parquet tables below a path, each load's rows in folders of their own, facts partitioned by entity within them.

    Nothing is rewritten. Rows of a load are read once it is committed, in the order of commits. Live facts and conflicts
    of an entity are those of the last load that replaced them; a chunk that was put again with the same id replaces the
    one before; of what changes bit by bit (states of files, users' resolutions, cached headers) the last word counts.
    Facts and chunks of files in state RESET are out of sight. begin() opens a load, which reads what was committed
    before it and what it has itself written; append, overwrite, upsert and log outside of a load are loads of their own.
    """

    PARTITIONED = ("staging_facts", "live_facts", "conflicts", "qualitative_chunks")
    #: Tables of which an entity has only the rows of the last load that replaced them.
    VERSIONED = ("live_facts", "conflicts")

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.load_id: str | None = None
        self.seen: int | None = None  # the last commit that a load knows of
        self._commits: dict[str, dict] = {}  # files of the journal, which never change

    # -- files of the journal

    def _hadoop(self, path: str):
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at = at.getFileSystem(conf).makeQualified(at)
        return jvm, conf, at, at.getFileSystem(conf)

    def _put(self, path: str, content: dict) -> bool:
        """Create a file as a whole, unless it is there: written aside, then renamed, which one of two writers can do."""
        jvm, conf, aside, fs = self._hadoop(f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), conf).rename(aside, self._hadoop(path)[2], options)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            fs.delete(aside, False)
            return False

    def _names(self, path: str) -> list[str]:
        """Names in a folder, in order, without hidden ones."""
        _, _, at, fs = self._hadoop(path)
        return sorted(n for n in (f.getPath().getName() for f in fs.listStatus(at)) if n[0] not in "._") if fs.exists(at) else []

    def _content(self, path: str) -> dict:
        jvm, _, at, fs = self._hadoop(path)
        stream = fs.open(at)
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def reserve(self, kind: str, n: int) -> int:
        """The first of n ids that no other load gets; ids that a failed load had are not used again."""
        while True:
            names = self._names(f"{self.path}/_ids/{kind}")
            last = self._content(f"{self.path}/_ids/{kind}/{names[-1]}") if names else {"first": 1, "n": 0}
            first = last["first"] + last["n"]
            if self._put(f"{self.path}/_ids/{kind}/{first:019d}", {"first": first, "n": max(1, n)}):
                return first

    # -- loads

    def _journal(self) -> DataFrame:
        """seq, load_id, name of committed loads, as far as this store or load knows of them: a row for each load."""
        fields = "seq long, load_id string, name string"
        new = [n for n in self._names(f"{self.path}/_journal") if n not in self._commits]
        if len(new) > 100:
            rows = self.spark.read.schema(fields).json([f"{self.path}/_journal/{n}" for n in new]).collect()  # a row for each load
            self._commits |= {f"{r['seq']:012d}.json": r.asDict() for r in rows}
        else:
            self._commits |= {n: self._content(f"{self.path}/_journal/{n}") for n in new}
        rows = [(c["seq"], c["load_id"], c["name"]) for c in self._commits.values() if self.seen is None or c["seq"] <= self.seen]
        if len(rows) > 1000:
            return self.spark.createDataFrame(rows, fields)
        said = ", ".join(f"({a}L, :i{k}, :n{k})" for k, (a, _, _) in enumerate(rows)) or "(0L, '', '')"
        args = {f"{x}{k}": r[j] for k, r in enumerate(rows) for x, j in (("i", 1), ("n", 2))}
        return self.spark.sql(f"SELECT * FROM VALUES {said} AS t(seq, load_id, name) WHERE seq > 0", args=args)  # planned without a job

    def _visible(self) -> DataFrame:
        done = self._journal().select("load_id", "seq")
        return done if self.load_id is None else done.unionAll(self.spark.sql(f"SELECT '{self.load_id}' AS load_id, {1 << 62}L AS seq"))

    def begin(self, name: str | None = None) -> Store | None:
        """A load. name: what it is known by, once it is committed; None is returned if a load of this name was."""
        names = self._names(f"{self.path}/_journal")
        if name is not None and names and self._journal().where(F.col("name") == name).limit(1).count():
            return None
        load = type(self)(self.spark, self.path)
        load._commits = dict(self._commits)
        load.load_id, load.name, load.seen = uuid.uuid4().hex, name, int(names[-1].split(".")[0]) if names else 0
        return load

    def commit(self) -> None:
        """Make all that the load wrote visible at once; raises Clash, and leaves it out of sight, if others have loaded the same meanwhile."""
        seq = self.seen + 1
        while not self._put(f"{self.path}/_journal/{seq:012d}.json", {"seq": seq, "load_id": self.load_id, "name": self.name}):
            others = type(self)(self.spark, self.path)._journal().where(F.col("seq") > self.seen)
            if self.name is not None and others.where(F.col("name") == self.name).limit(1).count():
                raise Clash(self.name)
            for table, key in (("replaced", ["table_name", "key"]), ("source_files", ["checksum"]), ("entities", ["entity_slug"])):
                rows = self._raw(table)
                if rows is None:
                    continue
                mine = rows.where(F.col("load_id") == self.load_id).select(*key)
                if rows.join(others.select("load_id"), "load_id").join(mine, key, "left_semi").limit(1).count():
                    raise Clash(table)
            seq += 1

    def vacuum(self, older_than_hours: float = 24.0) -> int:
        """Delete the folders of loads that were never committed and are older, and of replaced versions of live facts and conflicts. Returns how many."""
        done = {r["load_id"] for r in self._journal().select("load_id").collect()}  # a name for each load
        limit, gone = (time.time() - older_than_hours * 3600) * 1000, 0
        for table in SCHEMAS:
            last = None
            if table in self.VERSIONED:
                last = {r["load_id"] for r in self._versions(table).select("load_id").distinct().collect()}
            _, _, at, fs = self._hadoop(self._at(table))
            for f in fs.listStatus(at) if fs.exists(at) else ():
                load = f.getPath().getName().removeprefix("load_id=")
                if f.getPath().getName().startswith("load_id=") and f.getModificationTime() <= limit and (load not in done or last is not None and load not in last):
                    gone += fs.delete(f.getPath(), True)
        return gone

    # -- rows

    def _at(self, table: str) -> str:
        return f"{self.path}/{table}"

    def _raw(self, table: str) -> DataFrame | None:
        """All rows that any load wrote, with load_id; None if there are none."""
        _, _, at, fs = self._hadoop(self._at(table))
        if not fs.exists(at):
            return None
        return self.spark.read.schema(schema(table).add("load_id", "string")).option("basePath", self._at(table)).parquet(self._at(table))

    def _stored(self, table: str, *more: str) -> DataFrame:
        """Rows of visible loads; more: seq, the load's place in the order of commits."""
        rows = self._raw(table)
        if rows is None:
            rows = self.spark.createDataFrame([], schema(table).add("load_id", "string"))
        rows = rows.join(F.broadcast(self._visible()), "load_id")  # a row for each load
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema(table)], *more)

    def _replaced(self, table: str) -> DataFrame:
        """load_id and seq of every replacing of a key."""
        rows = self._raw("replaced")
        if rows is None:
            rows = self.spark.createDataFrame([], schema("replaced").add("load_id", "string"))
        return rows.where(F.col("table_name") == table).join(F.broadcast(self._visible()), "load_id").select("key", "load_id", "seq")

    def _versions(self, table: str) -> DataFrame:
        """The load whose rows hold, for each entity."""
        return self._replaced(table).groupBy(F.col("key").cast("int").alias("entity_id")).agg(F.max_by("load_id", "seq").alias("load_id"))

    def _current(self, table: str) -> DataFrame:
        rows = self._raw(table)
        if rows is None:
            return self.spark.createDataFrame([], schema(table))
        return conform(rows.join(self._versions(table), ["entity_id", "load_id"]), table)

    def read(self, table: str) -> DataFrame:
        if table in self.VERSIONED:
            rows = self._current(table)
        elif table == "qualitative_chunks" and self._names(self._at("replaced")):
            gone = self._replaced(table).groupBy(F.col("key").cast("long").alias("chunk_id")).agg(F.max("seq").alias("since"))
            rows = self._stored(table, "seq").join(gone, "chunk_id", "left").where("since IS NULL OR seq >= since")
            rows = conform(rows, table)
        else:
            rows = self._stored(table)
        if table == "source_files":
            states = latest(self._stored("file_states", "seq").withColumn("nth", F.struct("seq", "nth")).drop("seq"), "file_id").select("file_id", F.col("state").alias("now"), "moved_at")
            live_at = F.when(F.col("now") == "LIVE", F.col("moved_at")).otherwise(F.col("live_at"))
            rows = rows.join(states, "file_id", "left").withColumn("state", F.coalesce("now", "state")).withColumn("live_at", live_at)
            return conform(rows, table)
        if table in ("resolutions", "header_cache"):
            return latest(rows, *({"resolutions": ("entity_id", "canonical_field", "period"), "header_cache": ("header_key",)}[table])).select(*rows.columns)
        if table in ("staging_facts", "live_facts", "qualitative_chunks", "conflicts") and self._names(self._at("file_states")):
            hidden = self._stored("file_states").where("state = 'RESET'").select("file_id")  # no file comes back: loaded again, it is another
            if table == "conflicts":
                gone = self._stored("staging_facts").join(hidden, "file_id", "left_semi").select(F.col("staging_id").alias("gone"))
                of = rows.select("conflict_id", F.explode("staging_ids").alias("gone")).join(gone, "gone").select("conflict_id").distinct()
                return rows.join(of, "conflict_id", "left_anti").select(*rows.columns)
            of = "source_file_id" if table == "live_facts" else "file_id"
            return rows.join(hidden.select(F.col("file_id").alias(of)), of, "left_anti").select(*rows.columns)
        return rows

    def _write(self, table: str, df: DataFrame) -> int:
        seen = Observation()
        out = conform(df, table).observe(seen, F.count(F.lit(1)).alias("rows"))
        if table in self.PARTITIONED:
            out = out.repartition("entity_id")  # a file for each entity, not for each task and entity
        out = out.write.mode("append")  # to a folder of its own, as two writers to one folder would clear each other's unfinished files
        (out.partitionBy("entity_id") if table in self.PARTITIONED else out).parquet(f"{self._at(table)}/load_id={self.load_id}")
        try:
            return seen.get["rows"]
        except Py4JJavaError:  # as in scratch()
            return self._raw(table).where(F.col("load_id") == self.load_id).count()

    def _in_load(self, method: str, *args) -> int:
        load = self.begin()
        n = getattr(load, method)(*args)
        load.commit()
        return n

    def append(self, table: str, df: DataFrame) -> int:
        """Add rows; to live facts and conflicts, those of entities that are replaced by them. Like overwrite and upsert it returns their number."""
        if table in self.VERSIONED:
            return self.overwrite(table, df)
        return self._in_load("append", table, df) if self.load_id is None else self._write(table, df)

    def log(self, table: str, df: DataFrame) -> None:
        """Append rows that are the last word for their keys."""
        self.append(table, df.withColumn("nth", F.lit(time.time_ns())))

    def overwrite(self, table: str, df: DataFrame, entities: DataFrame | None = None) -> int:
        """Replace the rows of entities (entity_id; those in df, if not given) by those of df."""
        if self.load_id is None:
            return self._in_load("overwrite", table, df, entities)
        n = self._write(table, df)
        of = entities if entities is not None else self._raw(table).where(F.col("load_id") == self.load_id)
        self._write("replaced", of.select(F.lit(table).alias("table_name"), F.col("entity_id").cast("string").alias("key")).distinct())
        return n

    def upsert(self, table: str, df: DataFrame, key: str) -> int:
        """Put rows in place of those with the same key; rows must not share a key."""
        if self.load_id is None:
            return self._in_load("upsert", table, df, key)
        n = self._write(table, df)
        mine = self._raw(table).where(F.col("load_id") == self.load_id).select(key)
        old = self._stored(table, "seq").where(F.col("seq") <= self.seen).select(key)
        self._write("replaced", old.join(mine, key, "left_semi").select(F.lit(table).alias("table_name"), F.col(key).cast("string").alias("key")).distinct())
        return n


def move(files: DataFrame, state: str, chosen) -> DataFrame:
    """Files with the chosen ones in another state; a step that STATES does not allow raises."""
    allowed = [s for s, to in STATES.items() if state in to]
    wrong = F.raise_error(F.concat(F.lit(f"no way to {state} from "), F.coalesce("state", F.lit("nothing"))))
    to = F.when(~chosen, F.col("state")).when(F.col("state").isin(*allowed), F.lit(state)).otherwise(wrong)
    return files.withColumn("live_at", F.when(chosen & F.lit(state == "LIVE"), F.current_timestamp()).otherwise(F.col("live_at"))).withColumn("state", to)
