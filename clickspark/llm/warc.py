"""WARC archives: writing records, and reading them back by verified
boundary chains.

Writing: one text row per record, ``header CRLF CRLF payload``, with CRLF CRLF
as the line separator, so Spark's text sink (its commit protocol included)
writes plain WARC files.  Of records with equal payloads of ``dedup_bytes`` at
least, the one with the largest page_id is a response and the others are
revisits without payload; shorter payloads are all responses.

Reading: the text source splits the files at the record magic, wherever the
magic occurs, inside payloads too.  Every piece after a magic is a candidate
record.  Offsets are prefix sums of piece lengths within a split plus the
lengths of the file's earlier splits, and a candidate's header gives the
offset of its successor.  Records are the candidates reachable from the file
start: inside a split the chain from every candidate is followed to the
first offset beyond the split (one task per split), and across the splits of
a file pointer jumping doubles the reach per round.  Candidates off the chain
lie in a payload; their bytes are put back by a second scan, only when there
are any.

Rows: a null payload is empty; null page_ids are written as an empty id and
read back as null; of repeated rows that share the largest page_id all are
responses, null page_ids revisit whatever has an id; extra columns are
ignored; an empty table gives an empty result."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickspark.llm.common import importable, map_rows, table
from clickspark.staging import new_path, stage_table

MAGIC, BREAK = "WARC/1.1\r\n", "\r\n\r\n"
#: Contract value: smallest payload that is stored once.
DEDUP_BYTES = 0
_URI = "https://archive.example/page/"


def base32_sha1(payload) -> F.Column:
    """Upper-case base32 of a binary column's SHA-1: 20 bits (5 hex digits,
    4 base32 digits) at a time."""
    hexa = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexa, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_warc(pages: DataFrame, path: str, dedup_bytes: int = DEDUP_BYTES, payload: str = "html") -> None:
    """Write one record per row of ``pages`` (page_id, url, payload column)."""
    p = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"),
                     F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("body"))
    p = p.withColumn("size", F.octet_length("body")).withColumn("digest", base32_sha1(F.col("body").cast("binary")))
    # one narrow row per payload; the copies' pages are compared with it
    owner = (p.where(F.col("size") >= dedup_bytes).groupBy("digest")
             .agg(F.max("page_id").alias("owner")).withColumnRenamed("digest", "od"))
    p = p.join(owner, p.digest == F.col("od"), "left")
    revisit = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    uri = lambda c: F.concat(F.lit(_URI), F.coalesce(c.cast("string"), F.lit("")))
    clean = F.regexp_replace("url", r"[\r\n]", "")
    header = F.concat_ws(
        "\r\n",
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <"), uri(F.col("page_id")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <"), uri(F.col("owner")), F.lit(">"))),
        F.when(revisit, F.concat(F.lit("WARC-Payload-Length: "), F.col("size").cast("string"))),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))))
    record = F.concat(F.lit(MAGIC), header, F.lit(BREAK), F.when(revisit, F.lit("")).otherwise(F.col("body")))
    p.select(record.alias("value")).write.option("lineSep", BREAK).text(path)


def _header(piece: bytes) -> tuple[int, dict[str, str]] | None:
    """Length of the header (with its blank line) and its fields, or None."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in piece[:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        return None
    return end + 4, fields


_PIECES = ("file string, block long, seq long, size long, head long, body long, type string, page string, "
           "refers string, stated_digest string, stated_length long, digest string")


def _page(uri: str) -> str:
    return uri.strip("<>").rpartition("/")[2]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between two magics, in file order: ``seq`` counts within the
    task, ``size`` is its bytes."""
    df = spark.read.option("lineSep", MAGIC).text(path)
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("seq"), F.col("value").cast("binary").alias("value"))


def _scanned(batches):
    names = [c.split()[0] for c in _PIECES.split(", ")]
    for b in batches:
        rows = []
        for file, block, seq, v in zip(b["file"], b["block"], b["seq"], b["value"]):
            found = _header(v)
            if found is None:
                rows.append((file, block, seq, len(v), None, None, None, None, None, None, None, None))
                continue
            head, f = found
            body = int(f["content-length"])
            own = (base64.b32encode(hashlib.sha1(v[head:head + body]).digest()).decode()
                   if len(v) >= head + body else None)
            rows.append((file, block, seq, len(v), head, body, f["warc-type"], _page(f.get("warc-record-id", "")),
                         _page(f.get("warc-refers-to", "")), f.get("warc-payload-digest", "").removeprefix("sha1:"),
                         int(f["warc-payload-length"]) if f.get("warc-payload-length", "").isdigit() else None, own))
        yield dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}


def _chase(g: pd.DataFrame) -> pd.DataFrame:
    """Within one split: the first offset beyond it that the chain from each
    candidate leads to (null: the chain breaks here)."""
    g = g.sort_values("at", kind="stable", ignore_index=True)
    at, nxt = g["at"].to_numpy(), g["next"].to_numpy(np.float64)
    known = {}
    exits = np.full(len(g), np.nan)
    for i in range(len(g) - 1, -1, -1):
        n = nxt[i]
        if not np.isnan(n):
            # successors inside the split that are no candidates break the chain
            exits[i] = known.get(int(n), n if n >= g["until"].iat[i] else np.nan)
        known[int(at[i])] = exits[i]
    return pd.DataFrame({"file": g["file"], "at": at, "exit": pd.array(exits, dtype="Float64").astype("Int64")})


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, record_type, refers_to, payload_bytes,
    payload_digest (of the stored payload, revisits: as their header says)."""
    importable(spark)
    pieces = stage_table(map_rows(_pieces(spark, path), _scanned, _PIECES))
    # offsets: a piece's magic ends where the piece begins
    per = pieces.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("total"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"), "total")
    inside = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum(F.col("size") + len(MAGIC)).over(inside), F.lit(0))
    placed = (pieces.join(base, ["file", "block"])
              .withColumn("at", start - len(MAGIC))  # offset of the magic; before the first magic of a file: negative
              .withColumn("until", F.col("base") + F.col("total") - len(MAGIC)))
    placed = placed.withColumn("next", F.col("at") + len(MAGIC) + F.col("head") + F.col("body") + len(BREAK))
    placed = stage_table(placed)
    candidates = placed.where((F.col("at") >= 0) & F.col("next").isNotNull())
    exits = stage_table(candidates.select("file", "block", "at", "next", "until").groupBy("file", "block")
                        .applyInPandas(_chase, "file string, at long, exit long"))
    heads = _entered(exits)
    records = _walked(candidates, heads)
    return _payloads(spark, path, placed, stage_table(records))


def _entered(exits: DataFrame) -> DataFrame:
    """(file, at): where the chain from the file start enters each split.
    ``jump`` doubles: after round k it spans 2^k splits."""
    reach = exits.where("at = 0").select("file", "at")
    jump = exits.where("exit is not null")
    while True:
        new = (reach.join(jump, ["file", "at"]).select("file", F.col("exit").alias("at"))
               .join(exits.select("file", "at"), ["file", "at"], "left_semi").join(reach, ["file", "at"], "left_anti"))
        new = stage_table(new)
        if new.isEmpty():
            return reach
        reach = reach.union(new)
        ahead = jump.select("file", F.col("at").alias("exit"), F.col("exit").alias("further"))
        jump = stage_table(jump.join(ahead, ["file", "exit"]).select("file", "at", F.col("further").alias("exit")))


def _walked(candidates: DataFrame, heads: DataFrame) -> DataFrame:
    """The records: in each split, the candidates on the chain from where it
    was entered."""
    entry = candidates.select("file", "at", "block").join(heads, ["file", "at"]).select(
        "file", "block", F.col("at").alias("entry"))
    marked = candidates.select("file", "block", "at", "next").join(entry, ["file", "block"])

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        step = dict(zip(g["at"].tolist(), g["next"].tolist()))
        at, on = int(g["entry"].iat[0]), []
        while at in step:
            on.append(at)
            at = step.pop(at)
        return pd.DataFrame({"file": g["file"].iat[0], "at": np.array(on, np.int64)})

    on = marked.groupBy("file", "block").applyInPandas(walk, "file string, at long")
    return candidates.join(on, ["file", "at"])


def _payloads(spark: SparkSession, path: str, placed: DataFrame, records: DataFrame) -> DataFrame:
    """Records with the digest of their whole payload, which may lie in
    several pieces."""
    whole = records.where("digest is not null")
    torn = records.where("digest is null")
    if not torn.isEmpty():
        importable(spark)
        spans = torn.select("file", F.col("at").alias("owner"), "head", "body", F.col("next").alias("stop"))
        # a torn record's pieces: its own and the candidates before its end; records are disjoint,
        # so a piece's owner is the last record at or before it
        own = (placed.where("at >= 0").select("file", "block", "seq", "at")
               .join(torn.select("file", F.col("at"), F.lit(True).alias("is_torn")), ["file", "at"], "left")
               .join(whole.select("file", "at", F.lit(True).alias("is_whole")), ["file", "at"], "left"))
        last = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        mark = F.when(F.col("is_torn"), F.col("at")).when(F.col("is_whole"), F.lit(-1))
        need = (own.withColumn("owner", F.last(mark, ignorenulls=True).over(last)).where("owner >= 0")
                .join(spans, ["file", "owner"]).where("at < stop"))
        bytes_ = need.join(_pieces(spark, path), ["file", "block", "seq"])

        def digest(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("at")
            head, body = int(g["head"].iat[0]), int(g["body"].iat[0])
            data = MAGIC.encode().join(g["value"])[head:head + body]
            return pd.DataFrame({"file": [key[0]], "at": [key[1]], "whole":
                                 [base64.b32encode(hashlib.sha1(data).digest()).decode()]})

        found = bytes_.groupBy("file", "owner").applyInPandas(digest, "file string, at long, whole string")
        fixed = torn.join(found, ["file", "at"]).withColumn("digest", F.col("whole")).drop("whole")
        whole = whole.unionByName(fixed)
    revisit = F.col("type") == "revisit"
    page = lambda c: F.when(F.col(c) != "", F.col(c)).cast("long")
    return whole.select(
        page("page").alias("page_id"), F.when(revisit, F.col("stated_length")).otherwise(F.col("body")).alias("payload_bytes"),
        F.when(revisit, F.col("stated_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"), F.when(revisit, page("refers")).alias("refers_to"))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: all pages written as WARC files in the shared folder, read back."""
    path = new_path(spark, "clickspark_warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path)
