"""Merkle fixity audit of web archive replicas.

Records are rendered as WARC records and hashed; a record's place in its archive file is an offset range. Consecutive
ranges are hashed into nodes, and nodes into the next level, up to one root a replica. An audit compares roots and
descends, level by level, only below nodes that differ, so equal replicas cost one comparison however large they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CRLF = "\r\n"


def warc_record(uri: Column, payload: Column) -> Column:
    """A WARC/1.1 resource record: header, blank line, payload and the two closing line ends. Null parts are empty."""
    body = F.coalesce(payload, F.lit(""))
    head = [
        F.lit(f"WARC/1.1{CRLF}WARC-Type: resource{CRLF}WARC-Target-URI: "), F.coalesce(uri, F.lit("")), F.lit(f"{CRLF}Content-Type: text/html{CRLF}Content-Length: "),
        F.octet_length(body).cast("string"), F.lit(CRLF + CRLF),
    ]
    return F.concat(*head, body, F.lit(CRLF + CRLF))


def record_leaves(pages: DataFrame, id_col: str, uri_col: str, payload_col: str, file_records: int) -> DataFrame:
    """(id, file_no, lo, hi, digest): each record's offset range in its file, and its hash.

    Files hold the records of file_records consecutive ids. Rows of one id are one entry: its digest covers all of them
    in the order of their own digests.
    """
    record = warc_record(F.col(uri_col).cast("string"), F.col(payload_col).cast("string"))
    each = pages.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.explode(F.array(record)).alias("record")
    ).select("id", F.octet_length("record").cast("long").alias("n"), F.sha2("record", 256).alias("digest"))
    # rows of one id: their digests are summed up in halves, so that a repeated id gathers nothing
    parts = [F.sum(F.conv(F.substring("digest", 1 + 14 * i, 14), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    own = each.groupBy("id").agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.min("digest").alias("one"), F.concat_ws(",", *parts).alias("many"))
    own = own.select("id", F.floor(F.col("id") / file_records).alias("file_no"), "n", F.when(F.col("rows") == 1, F.col("one")).otherwise(F.sha2("many", 256)).alias("digest"))
    end = F.sum("n").over(Window.partitionBy("file_no").orderBy("id"))
    return own.select("id", "file_no", (end - F.col("n")).alias("lo"), end.alias("hi"), "digest")


@dataclass
class MerkleTree:
    """levels[0] are leaves (id, file_no, lo, hi, digest); each further level (node, bytes, digest); fanout children to a node."""

    levels: list[DataFrame]
    fanout: int

    @property
    def root(self) -> str | None:
        top = self.levels[-1].select("digest").first()
        return top["digest"] if top else None


def level_above(below: DataFrame, child: str, fanout: int) -> DataFrame:
    """(node, bytes, digest): a node hashes its children's numbers, bytes and digests in order, which are its offset ranges
    from its own beginning on; at most fanout of them are gathered."""
    kids = F.array_sort(F.collect_list(F.concat_ws(":", F.lpad(F.col(child).cast("string"), 20, "0"), F.col("bytes").cast("string"), "digest")))
    return below.groupBy(F.floor(F.col(child) / fanout).alias("node")).agg(F.sum("bytes").alias("bytes"), F.sha2(F.array_join(kids, ","), 256).alias("digest"))


def merkle_tree(
    pages: DataFrame, top_level: int, fanout: int = 32, file_records: int = 1024, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html"
) -> MerkleTree:
    """The tree of a replica, every level written to the shared folder, with top_level levels above the leaves."""
    levels = [written(record_leaves(pages, id_col, uri_col, payload_col, file_records), "leaves")]
    for n in range(top_level):
        below = levels[-1] if n else levels[0].withColumn("bytes", F.col("hi") - F.col("lo"))
        levels.append(written(level_above(below, "node" if n else "id", fanout), f"level{n + 1}"))
    return MerkleTree(levels, fanout)


def height(greatest: int, fanout: int) -> int:
    """How many levels above the leaves bring ids 0 to greatest under one root."""
    n = 1
    while (greatest := greatest // fanout) > 0:
        n += 1
    return n


def audit(left: DataFrame, right: DataFrame, fanout: int = 32, file_records: int = 1024, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Where replicas differ: (id, status, file_no, lo, hi) with status altered, missing (from right) or extra (in right).

    file_no, lo and hi are the record's file and offset range in the replica that holds it, left first. Equal replicas
    give no rows, as do two empty ones. Null ids can't be told apart and take no part; ids must not be negative. Null
    payloads are empty ones. Rows of one id are compared together. Extra columns are ignored. Ids map to nodes by
    division, so ranges have at most fanout children however ids or hosts are distributed, and no level is a hot key.
    """
    greatest = max(int(df.agg(F.max(F.col(id_col).cast("long"))).first()[0] or 0) for df in (left, right))
    top = height(greatest, fanout)
    a, b = (merkle_tree(df, top, fanout, file_records, id_col, uri_col, payload_col) for df in (left, right))
    suspect: DataFrame | None = None
    for n in range(top, 0, -1):
        own = [t.levels[n] if suspect is None else t.levels[n].join(suspect, F.floor(F.col("node") / fanout) == F.col("parent"), "left_semi") for t in (a, b)]
        x, y = (df.select("node", F.col("digest").alias(f"digest_{k}")) for k, df in zip("ab", own, strict=True))
        differ = x.join(y, "node", "full").where(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
        suspect = written(differ.select(F.col("node").alias("parent")), f"differ{n}")
        if suspect.isEmpty():
            break
    below = lambda t, k: t.levels[0].join(suspect, F.floor(F.col("id") / fanout) == F.col("parent"), "left_semi").select(
        "id", *[F.col(c).alias(f"{c}_{k}") for c in ("file_no", "lo", "hi", "digest")]
    )
    pairs = below(a, "a").join(below(b, "b"), "id", "full").where(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
    status = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("altered")
    return pairs.select("id", status.alias("status"), *[F.coalesce(f"{c}_a", f"{c}_b").alias(c) for c in ("file_no", "lo", "hi")])


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with faults at known places, for drills: a payload with a byte more, one emptied, a lost record, a foreign one.

    The places follow from page_id alone, so repeated rows and equal ids fare alike; rows with a null id are lost, null
    payloads stay null unless they are emptied, extra columns stay, and an empty table stays empty.
    """
    n, html = F.col("page_id"), F.col("html")
    kept = pages.where(F.pmod(n, F.lit(211)) != 13)
    bad = F.when(F.pmod(n, F.lit(97)) == 5, F.concat(html, F.lit("\u0000"))).when(F.pmod(n, F.lit(389)) == 7, F.lit("")).otherwise(html)
    extra = pages.where(F.pmod(n, F.lit(503)) == 11).withColumn("page_id", n + 1_000_000_007)
    return kept.withColumn("html", bad).unionByName(extra)
