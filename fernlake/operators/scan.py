"""From a snapshot and a predicate to a DataFrame: visible files, pruned, aligned, without deleted rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernlake.errors import LakeError, Partial
from fernlake.plans import prune
from fernlake.sources.snapshot import Snapshot

#: Hidden columns that say where a row lies.
FILE, ROW = "__file", "__row"
#: Bytes that a deleted position takes in a join's table, besides its file's name.
POSITION_BYTES = 64


@dataclass
class ScanInfo:
    """What a scan read, left out and missed."""

    files: list[str] = field(default_factory=list)
    pruned: list[str] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)

    @property
    def partial(self) -> bool:
        return bool(self.missing)


def aligned(df: DataFrame, schema: T.StructType, extra: tuple[str, ...] = ()) -> DataFrame:
    """Columns by name (in any case), null where missing, cast to the schema's types."""
    own = {c.lower(): c for c in df.columns}
    columns = [(F.col(f"`{own[f.name.lower()]}`") if f.name.lower() in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*columns, *extra)


def nullable(kind: T.DataType) -> T.DataType:
    """The type with null allowed at every depth."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(nullable(kind.keyType), nullable(kind.valueType), True)
    return as_nullable(kind) if isinstance(kind, T.StructType) else kind


def as_nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, nullable(f.dataType), True, f.metadata) for f in schema])


def scan(
    spark: SparkSession, snapshot: Snapshot, table: str, where: str | None = None, *,
    pruning: bool = True, shard: str | None = None, only: set[str] | None = None, missing: str = "error",
    exists=None, budget: int = 0, positions: bool = False,
) -> tuple[DataFrame, ScanInfo]:
    """The table's rows at the snapshot that satisfy where, and what was read for them.

    missing: "error", "reject" (both raise for files that are gone) or "allow", which marks the answer as partial.
    budget: most bytes of files to read, 0 for any.
    """
    schema = snapshot.schema_of(table)
    info = ScanInfo()
    tree = prune.parse(spark, where) if where and pruning else None
    kept = []
    for file in snapshot.visible(table, shard):
        if only is not None and file["path"] not in only:
            continue
        if exists is not None and not exists(file["path"]):
            info.missing.append(file["path"])
        elif tree is not None and prune.can_skip(tree, file["stats"], file["rows"], schema):
            info.pruned.append(file["path"])
        else:
            kept.append(file)
            info.files.append(file["path"])
    if info.missing and missing != "allow":
        raise Partial(f"missing sources: {', '.join(info.missing)}")
    if budget and sum(f["bytes"] for f in kept) > budget:
        raise LakeError(f"the query would read more than {budget} bytes")
    hidden = (FILE, ROW) if positions else ()
    # Nullability is dropped throughout: older files may lack a column.
    wanted = as_nullable(schema)
    out = None
    deleted = {v["file"]: [] for v in snapshot.live_vectors()}
    for v in snapshot.live_vectors():
        deleted[v["file"]].append(v)
    groups: dict[tuple[int, bool], list[dict]] = {}
    for file in kept:
        groups.setdefault((file["schema_version"], file["path"] in deleted), []).append(file)
    for (version, has_vector), files in sorted(groups.items()):
        paths = [f["path"] for f in files]
        df = spark.read.schema(as_nullable(snapshot.schema_of(table, version))).parquet(*paths)
        if has_vector or positions:
            df = df.withColumns({FILE: F.col("_metadata.file_path"), ROW: F.col("_metadata.row_index")})
        if has_vector:
            vectors = {v["path"]: v for p in paths for v in deleted[p]}
            gone = spark.read.schema("file string, row long").parquet(*vectors).where(F.col("file").isin(paths)).distinct()
            # Positions pack so well that their files' size says nothing about what they take in memory.
            held = sum(v["card"] * (len(p) + POSITION_BYTES) for p in paths for v in deleted[p])
            if held > spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold():
                gone = gone.hint("merge")
            df = df.join(gone, (df[FILE] == gone["file"]) & (df[ROW] == gone["row"]), "left_anti")
        part = aligned(df, wanted, hidden)
        out = part if out is None else out.unionByName(part)
    if out is None:
        hidden_fields = [T.StructField(FILE, T.StringType()), T.StructField(ROW, T.LongType())] if positions else []
        out = spark.createDataFrame([], T.StructType([*wanted, *hidden_fields]))
    return (out.where(where) if where else out), info
