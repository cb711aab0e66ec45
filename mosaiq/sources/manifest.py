"""Readers: manifests, source lists, review sheets, recognition results, capture requests, file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions import policy
from mosaiq.functions.texts import uid_from_text
from mosaiq.operators.ranks import first_per_key
from mosaiq.sources import schemas

IMAGE_NAMES = r"(?i)\.(png|jpe?g|webp|bmp)$"
#: What a manifest holds unless it says otherwise.
SCHEMA_VERSION, SPLIT_SEED, SPLIT_RATIO = "dataset-manifest-v1", 42, (0.8, 0.1, 0.1)


def first_object(text: Column) -> Column:
    """The first JSON object of a text that may hold garbage after it: up to the brace that closes the first one.

    Strings are blanked with the same length first, so braces inside them don't count; then the running depth of braces is
    found without a loop over rows. A text that isn't an object gives null.
    """
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', "")
    depth = F.length(F.regexp_replace(bare, "[^{]", "")) - F.length(F.regexp_replace(bare, "[^}]", ""))
    whole = F.when(depth == 0, text)
    parsed = F.try_parse_json(whole)
    cut = F.regexp_extract(text, r'(?s)^\s*(\{(?:[^{}"]|"(?:[^"\\]|\\.)*+"|\{(?:[^{}"]|"(?:[^"\\]|\\.)*+"|\{(?:[^{}"]|"(?:[^"\\]|\\.)*+"|\{(?:[^{}"]|"(?:[^"\\]|\\.)*+")*+\})*+\})*+\})*+\})', 1)
    return F.when(parsed.isNotNull(), text).otherwise(F.nullif(cut, F.lit("")))


def read_manifest(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a manifest file: meta (one row, defaults filled), sources, records (both with `ordinal`), splits (record_id, split).

    A manifest is one JSON object; elements of its lists that aren't objects are left out. Trailing garbage is cut off.
    """
    doc = spark.read.text(path, wholetext=True).select(F.try_parse_json(first_object(F.col("value"))).alias("m")).where("m is not null")
    ratio = ", ".join(str(x) for x in SPLIT_RATIO)
    meta = doc.select(
        F.coalesce(F.try_variant_get("m", "$.schemaVersion", "string"), F.lit(SCHEMA_VERSION)).alias("schemaVersion"),
        F.coalesce(F.try_variant_get("m", "$.splitSeed", "long"), F.lit(SPLIT_SEED).cast("long")).alias("splitSeed"),
        F.coalesce(F.try_variant_get("m", "$.splitRatio", "struct<train:double,val:double,test:double>"), F.expr(f"named_struct('train', {ratio.split(', ')[0]}D, 'val', {ratio.split(', ')[1]}D, 'test', {ratio.split(', ')[2]}D)")).alias("splitRatio"),
        F.coalesce(F.try_variant_get("m", "$.privateStorageRoot", "string"), F.lit("")).alias("privateStorageRoot"),
        F.try_variant_get("m", "$.updatedAt", "string").alias("updatedAt"),
    )

    def rows(name: str, schema: str) -> DataFrame:
        items = doc.select(F.posexplode(F.coalesce(F.try_variant_get("m", f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))).alias("ordinal", "v"))
        items = items.where(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))
        fields = split_fields(schemas.struct(schema)[7:-1])
        return items.select("ordinal", *[F.try_variant_get("v", f"$.{n}", t).alias(n) for n, t in fields])

    def piece(name: str) -> Column:
        ids = F.coalesce(F.try_variant_get("m", f"$.splits.{name}", "array<string>"), F.array().cast("array<string>"))
        return F.transform(ids, lambda x: F.struct(x.alias("record_id"), F.lit(name).alias("split")))

    pieces = [piece(name) for name in ("train", "val", "test")]
    splits = doc.select(F.posexplode(F.concat(*pieces)).alias("ordinal", "e")).select("ordinal", "e.*")
    # An id in several lists belongs to the last of train, val, test.
    splits = first_per_key(splits, ["record_id"], [F.desc("ordinal")]).drop("ordinal")
    return {"meta": meta, "sources": rows("sources", schemas.SOURCE), "records": rows("records", schemas.RECORD), "splits": splits}


def split_fields(body: str) -> list[tuple[str, str]]:
    out, depth, start = [], 0, 0
    for k, c in enumerate(body + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = body[start:k].split(":", 1)
            out.append((name, kind))
            start = k + 1
    return out


def read_source_list(spark: SparkSession, path: str) -> DataFrame:
    """Source descriptors of a JSON file that is one object or a list of them."""
    return spark.read.schema(schemas.SOURCE.replace("captureHints variant", "captureHints string")).json(path, multiLine=True)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, every cell a string; a byte-order mark before the first name goes."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return df.toDF(*[c.lstrip(chr(0xFEFF)) for c in df.columns])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")


def read_recognition(spark: SparkSession, path: str, most_digits: int = 10) -> DataFrame:
    """Recognition results [{id, text, error}]: record_id, variant ('' if the id names none), text, uid. The last of equal ids wins.
    A uid has ten digits, or up to most_digits where numbers are longer."""
    rows = spark.read.schema("id string, text string, error string").json(path, multiLine=True).withColumn("ordinal", F.monotonically_increasing_id())
    rows = first_per_key(rows.where(policy.text(F.col("id")) != ""), ["id"], [F.desc("ordinal")])
    part = lambda k: F.coalesce(F.try_element_at(F.split("id", "::", 2), F.lit(k)), F.lit(""))
    return rows.select(part(1).alias("record_id"), part(2).alias("variant"), F.coalesce("text", F.lit("")).alias("text"), uid_from_text(F.col("text"), most=most_digits).alias("uid"))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """clusterId, memberIds, representativePath of a cluster report."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "clusters array<struct<clusterId:int,memberIds:array<string>,representativePath:string>>").alias("r"))
    return doc.select(F.inline("r.clusters")).where("clusterId is not null")


def read_cluster_values(spark: SparkSession, path: str) -> DataFrame:
    """clusterId, uid, errors of a mapping {clusterId: uid}, or one under clusterUidValues. Bad ids and values are told, not thrown."""
    doc = spark.read.text(path, wholetext=True)
    values = F.coalesce(F.from_json("value", "clusterUidValues map<string,string>")["clusterUidValues"], F.from_json("value", "map<string,string>"))
    rows = doc.select(F.explode(values).alias("raw_id", "raw_uid"))
    ident, uid = F.trim("raw_id").try_cast("int"), F.regexp_replace(F.coalesce("raw_uid", F.lit("")), "[^0-9]", "")
    bad = F.concat_ws(";", F.when(ident.isNull(), F.lit("invalid_cluster_id")), F.when(~F.length(uid).between(6, 12), F.lit("invalid_uid")))
    return rows.select(ident.alias("clusterId"), uid.alias("uid"), bad.alias("errors"))


def parse_capture_spec(spec: Column) -> Column:
    """'role|path|agentId|slot|agentSlot|alias|page' -> struct with `errors` ('' if fine)."""
    parts = F.transform(F.split(F.coalesce(spec, F.lit("")), r"\|"), lambda x: F.trim(x))
    at = lambda k: F.nullif(F.try_element_at(parts, F.lit(k)), F.lit(""))
    whole = lambda k: at(k).try_cast("int")
    bad = [F.when(at(1).isNull() | at(2).isNull(), F.lit("role_and_path_required"))] + [F.when(at(k).isNotNull() & whole(k).isNull(), F.lit(f"{n}_not_integer")) for k, n in ((4, "slotIndex"), (5, "agentSlotIndex"), (7, "pageIndex"))]
    return F.struct(at(1).alias("role"), at(2).alias("path"), at(3).alias("agentId"), whole(4).alias("slotIndex"), whole(5).alias("agentSlotIndex"), at(6).alias("screenAlias"), whole(7).alias("pageIndex"), F.concat_ws(";", *bad).alias("errors"))


def parse_search_line(line: Column) -> Column:
    """'date|id|title' -> struct; the title may hold bars."""
    parts = F.split(F.trim(line), r"\|", 3)
    return F.struct(F.try_element_at(parts, F.lit(1)).alias("date"), F.try_element_at(parts, F.lit(2)).alias("id"), F.try_element_at(parts, F.lit(3)).alias("title"))


def captures(sessions: DataFrame) -> DataFrame:
    """One row per capture of each session: its screens, its uid crop, its icons. sessionId, role, path, alias, agentId, slotIndex,
    agentSlotIndex (global if the page is known and the slot is one of three), pageIndex."""
    text = policy.text
    listed = sessions.select("sessionId", F.posexplode("screenCaptures").alias("i", "c"))
    role = policy.first_text(F.col("c.role"), F.col("c.screenRole"))
    slot = policy.global_slot(F.col("c.pageIndex"), F.col("c.agentSlotIndex"))
    screens = listed.select("sessionId", role.alias("role"), text(F.col("c.path")).alias("path"), policy.first_text(F.col("c.screenAlias"), F.col("c.alias"), F.concat_ws("_", role, F.col("i").cast("string"))).alias("alias"), policy.first_text(F.col("c.agentId"), F.col("c.focusAgentId")).alias("agentId"), F.col("c.slotIndex").alias("slotIndex"), slot.alias("agentSlotIndex"), F.col("c.pageIndex").alias("pageIndex"))
    none = F.lit(None).cast("int")
    uid = sessions.select("sessionId", F.lit("uid_panel").alias("role"), text(F.col("uidImagePath")).alias("path"), F.lit("legacy_uid_crop").alias("alias"), F.lit("").alias("agentId"), none.alias("slotIndex"), none.alias("agentSlotIndex"), none.alias("pageIndex"))
    icons = sessions.select("sessionId", F.posexplode("agentIconPaths").alias("i", "c")).select("sessionId", F.lit("agent_icon_crop").alias("role"), text(F.col("c.path")).alias("path"), policy.first_text(F.col("c.screenAlias"), F.col("c.alias"), F.concat(F.lit("legacy_agent_icon_"), (F.col("i") + 1).cast("string"))).alias("alias"), F.lit("").alias("agentId"), none.alias("slotIndex"), F.col("c.agentSlotIndex").alias("agentSlotIndex"), F.col("c.pageIndex").alias("pageIndex"))
    return screens.unionByName(uid).unionByName(icons).where("role <> '' and path <> ''")


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modified, sha256 of all images below a folder; content is read only to be hashed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.where(F.rlike("path", F.lit(IMAGE_NAMES))).select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def ordered_files(files: DataFrame, start: int, end: int) -> DataFrame:
    """Files whose name holds '(N)' with N from start to end, by N: path, index."""
    name = F.element_at(F.split("path", "/"), -1)
    index = F.regexp_extract(name, r"\((\d+)\)", 1).try_cast("int")
    return files.select("path", index.alias("index"), name.alias("name")).where(F.col("index").between(start, end)).orderBy("index", "name").drop("name")


def ingested(files: DataFrame, dimensions: DataFrame, batch: str, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejects): new images by hash get a role from their path and an id from batch, role and hash. dimensions: path, width, height."""
    rows = files.withColumn("role", policy.path_role(F.col("path")))
    rejects = rows.where("role is null").select("path", F.lit("unclassified").alias("reason"))
    new = first_per_key(rows.where("role is not null").join(existing.select("sha256"), "sha256", "left_anti"), ["sha256"], [F.asc("path")])
    source = F.concat_ws("_", F.lit(batch), F.col("role"), F.substring("sha256", 1, 12))
    new = new.join(dimensions, "path", "left")
    records = new.select(F.concat(source, F.lit("_record")).alias("id"), source.alias("sourceId"), "role", "path", "sha256", policy.path_locale(F.col("path")).alias("locale"), policy.resolution(F.coalesce("width", F.lit(0)), F.coalesce("height", F.lit(0))).alias("resolution"))
    return records, rejects


def bootstrap(spark: SparkSession) -> dict[str, DataFrame]:
    """The empty tables of a new manifest."""
    kinds = {"meta": schemas.META, "sources": schemas.SOURCE, "records": schemas.RECORD, "splits": "record_id string, split string"}
    return {name: spark.createDataFrame([], schema) for name, schema in kinds.items()}
