"""Mix sources to target shares of all tokens, by systematic sampling.

Within a source the expected copies of its documents are summed up in order of
size; with one random offset per source a document comes out once for each whole
number that its stretch of the sum crosses.
"""

from __future__ import annotations

import ast
import base64
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.spread import spread
from .durable import durable
from .sizes import broadcast_checked

#: Folder and file of the public tokenizer that sizes are measured with.
TOKENIZERS_DIR, TOKENIZER = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
#: Documents of one source and size that are put in order in one task.
SLOT_ROWS = 200_000
#: Characters tokenized at once, where a longer text has a place at which the pattern cuts.
PART_CHARS = 200_000


def read_tokenizer(folder: str, name: str) -> tuple[str, dict[bytes, int], str]:
    """Name, ranks and pattern of a public tokenizer; the pattern is read as a constant, nothing in the folder is run."""
    with open(os.path.join(folder, name), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    with open(os.path.join(folder, "__init__.py")) as source:
        found = [n.value for n in ast.parse(source.read()).body if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "PATTERN" for t in n.targets)]
    return name, ranks, ast.literal_eval(found[0])


_encodings: list[tuple[object, object]] = []


def _encoding(value: tuple[str, dict[bytes, int], str]):
    """The encoding of a broadcast tokenizer, made once in each worker."""
    if not _encodings or _encodings[0][0] is not value:
        import tiktoken

        name, ranks, pattern = value
        _encodings[:] = [(value, tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))]
    return _encodings[0][1]


def _cuttable(text: str, at: int) -> bool:
    """Whether the pattern cuts before ``at``: a single blank between others that are none."""
    return text[at] == " " and not text[at - 1].isspace() and at + 1 < len(text) and not text[at + 1].isspace()


def _parts(text: str) -> list[str]:
    """A text in parts that together have as many tokens as the whole: it is cut where the pattern cuts as well, or not at all."""
    out, at = [], 0
    while len(text) - at > PART_CHARS:
        cut = at + PART_CHARS
        while cut > at + 1 and not _cuttable(text, cut):
            cut -= 1
        if cut == at + 1:
            cut = at + PART_CHARS
            while cut < len(text) and not _cuttable(text, cut):
                cut += 1
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]] if at < len(text) else out


def token_count(text: Column, folder: str, name: str = TOKENIZER) -> Column:
    """Tokens of a text by a public tokenizer, which the driver reads from ``folder`` and sends to the workers; 0 for null and empty."""
    shared = SparkSession.active().sparkContext.broadcast(read_tokenizer(folder, name))

    def run(texts: pa.Array) -> pa.Array:
        code = _encoding(shared.value)
        return pa.array([sum(len(code.encode_ordinary(p)) for p in _parts(t)) if t else 0 for t in texts.to_pylist()], pa.int64())

    return F.arrow_udf(run, "bigint")(text)


def plan_shares(sized: DataFrame, weights: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per listed source: its tokens, documents, aim and expected copies ``rate`` of each document.

    ``sized`` has ``source`` (in the form compared) and ``n_tokens``.  Without
    ``total_tokens`` the mix is made as large as it can be while every source that
    has tokens reaches its share within ``max_repeats``.  With it, sources that
    would need more repeats stop at ``max_repeats``.  The share of a listed source
    without tokens is spread over the others in proportion.
    """
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("have_tokens"), F.count("*").alias("have_docs"), F.max("n_tokens").alias("largest_doc"))
    norm = weights.where(F.col("source").isNotNull()).select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats")
    norm = norm.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = broadcast_checked(norm).join(have, "source", "left").na.fill(0, ["have_tokens", "have_docs", "largest_doc"]).na.fill(0.0, ["target_share"]).na.fill(1, ["max_repeats"])
    live = (F.col("have_tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    everyone = W.partitionBy(F.lit(1))
    rows = rows.withColumn("live_share", F.sum(F.when(live, F.col("target_share"))).over(everyone))
    rows = rows.withColumn("aim_share", F.when(live, F.col("target_share") / F.col("live_share")).otherwise(0.0))
    most = F.min(F.when(live, F.col("max_repeats") * F.col("have_tokens") / F.col("aim_share"))).over(everyone)
    rows = rows.withColumn("mix_tokens", F.lit(total_tokens).cast("double") if total_tokens is not None else most)
    rate = F.least(F.col("max_repeats").cast("double"), F.col("mix_tokens") * F.col("aim_share") / F.col("have_tokens"))
    return rows.select("source", "target_share", "max_repeats", "have_tokens", "have_docs", "largest_doc", "aim_share", "mix_tokens", F.when(live, rate).otherwise(0.0).alias("rate"))


def _numbered(df: DataFrame, source: str, key: str) -> DataFrame:
    """Add ``_place``: 0, 1, ... within each source in order of size class, slot, size.

    A source is cut into cells of size class and hash, so that no task orders a
    whole source, nor all the documents of one size; the cells' counts are summed
    up first.
    """
    slots = F.greatest(F.lit(1), F.ceil(F.col("have_docs") / SLOT_ROWS)).cast("bigint")
    cells = df.withColumn("_class", F.floor(F.log2(F.col("n_tokens") + 1) * 8)).withColumn("_slot", F.pmod(F.xxhash64(key, F.lit(11)), slots))
    counts = cells.groupBy(source, "_class", "_slot").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(source).orderBy("_class", "_slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(source, "_class", "_slot", before.alias("_before"))
    rank = F.row_number().over(W.partitionBy(source, "_class", "_slot").orderBy("n_tokens", F.xxhash64(key), key))
    return cells.join(starts, [source, "_class", "_slot"]).withColumn("_place", F.col("_before") + rank - 1).drop("_class", "_slot", "_before")


def mix_sources(docs: DataFrame, weights: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", total_tokens: int | None = None, seed: int = 7, folder: str = TOKENIZERS_DIR, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """``(mix, shares)``.

    ``mix`` has a row per document that is used: ``<key>``, ``source``, ``n_tokens``
    and how often it is used, ``copies`` (never above ``max_repeats``).  ``shares``
    has a row per listed source with ``target_share`` and the ``actual_share``
    reached, and with how many tokens that is off the aim, at most twice the largest
    document of the source: in order of size each pick stands for its neighbours, and
    a last stretch may be one document short or over.  Sources are compared without case and outer blanks; documents of
    sources that are not listed, or of none, are not used.  A document without
    text has no tokens and is not used.
    """
    sized = spread(docs.select(key, source, text)).select(F.col(key).alias("_key"), F.lower(F.trim(F.col(source))).alias("source"), token_count(F.col(text), folder, tokenizer).alias("n_tokens"))
    sized = durable(sized.where("source is not null and n_tokens > 0"))
    plan = durable(plan_shares(sized, weights, total_tokens))
    used = sized.join(broadcast_checked(plan.where("rate > 0").select("source", "rate", "max_repeats", "have_docs")), "source")
    placed = _numbered(used, "source", "_key")
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    upto = lambda k: F.floor((F.col("_place") + k) * F.col("rate") + offset)
    copies = F.least(upto(1) - upto(0), F.col("max_repeats")).cast("int")
    mix = placed.select(F.col("_key").alias(key), "source", "n_tokens", copies.alias("copies")).where("copies > 0")
    return mix, _shares(mix, plan)


def _shares(mix: DataFrame, plan: DataFrame) -> DataFrame:
    got = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.sum("copies").alias("records"), F.max("copies").alias("most_copies"))
    all_rows = plan.join(got, "source", "left").na.fill(0, ["mixed_tokens", "records", "most_copies"])
    total = F.sum("mixed_tokens").over(W.partitionBy(F.lit(1)))
    return all_rows.select("source", "target_share", (F.col("mixed_tokens") / F.when(total > 0, total)).alias("actual_share"), "mixed_tokens", "records", "most_copies", "max_repeats", "have_tokens", "have_docs", (F.abs(F.col("mixed_tokens") - F.col("rate") * F.col("have_tokens"))).alias("tokens_off"), (2 * F.col("largest_doc")).alias("most_tokens_off"))


def emit_copies(mix: DataFrame) -> DataFrame:
    """One row per copy: the rows of a mix with ``copy_no`` from 1."""
    return mix.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
