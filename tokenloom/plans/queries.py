"""The registered queries, each over whole tables. Id arrays are shown as digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.keys import keyed_uniform
from tokenloom.functions.tokenizers import ExternalTokenizer
from tokenloom.functions.text import (
    coerce_to_text,
    is_malformed_utf8,
    repair_utf8,
    utf8_length,
)
from tokenloom.operators import budget, clean, nextfit, order, prefix, runlog, shards, windows
from tokenloom.operators.lookup import interval_lookup
from tokenloom.operators.tokenize import tokenize
from tokenloom.plans import fixtures as fx
from tokenloom.plans.prepare import prepare, raw_stream
from tokenloom.session import materialize, settle, ship_package, stage_path
from tokenloom.sources.corpus import scan_corpus
from tokenloom.sources.metadata import dataset_meta, pass_columns, read_meta
from tokenloom.sources.shards import (
    encode_in_place,
    read_raw_shards,
    read_token_bins,
    read_token_shards,
    write_encoded_bins,
    write_encoded_shards,
    write_raw_shards,
)
from tokenloom.sources.storage import stored_bytes
from tokenloom.sources.tokenbin import TokenBinSource
from tokenloom.sources.zones import count_until_met, needed_zones
from tokenloom.streaming.ingest import (
    budgeted_ingest,
    read_ingested,
    read_skips,
    stream_corpus,
)
from tokenloom.streaming.metrics import live_best

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return function(spark, sf_dir)

    run.__name__, run.__doc__ = function.__name__, function.__doc__
    QUERIES[function.__name__] = run
    return run


def digest(ids: Column) -> Column:
    """Md5 of a comma-separated id list."""
    return F.md5(F.array_join(ids.cast("array<string>"), ","))


# Text ------------------------------------------------------------------------------------------


@query
def corpus_scan(spark, sf_dir):
    """The input order comes from the file names and their rows."""
    docs = scan_corpus(spark, {"documents": f"{sf_dir}/documents.parquet"})
    return docs.select("source", "seq", F.md5("text").alias("text_md5"))


def _arranged(spark, sf_dir, columns: str):
    """The documents in ``fx.FILES`` runs of ``doc_id``, a writing task each, so a file each."""
    docs = fx.table(spark, sf_dir, "documents").filter("doc_id is not null")
    last = docs.agg(F.max("doc_id")).first()[0]
    run = F.expr(f"doc_id div {-(-((last or 0) + 1) // fx.FILES)}").cast("int")
    docs = docs.withColumn("mix", fx.mixture_source()).withColumn("run", run)
    placed = docs.repartitionById(fx.FILES, F.col("run")).sortWithinPartitions("doc_id")
    return placed.select(*columns.split())


def _small_splits(spark, path: str):
    """A session of the same application that cuts the ``fx.FILES`` files of a folder into about
    ``fx.SPLITS`` splits each, within bounds on a split's bytes. With splits of one small size their
    number, a task each, would grow with the table.
    """
    session = spark.newSession()
    partitions = "spark.sql.shuffle.partitions"
    session.conf.set(partitions, spark.conf.get(partitions))
    split = stored_bytes(spark, path) // (fx.FILES * fx.SPLITS)
    split = min(max(split, fx.LEAST_SPLIT), fx.MOST_SPLIT)
    session.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    session.conf.set("spark.sql.files.openCostInBytes", "1k")
    return session


@query
def corpus_scan_json(spark, sf_dir):
    """The documents as JSON lines in several files, scanned in splits much smaller than these."""
    path = stage_path(spark, "json-lines")
    _arranged(spark, sf_dir, "text doc_id").write.json(path)
    docs = scan_corpus(_small_splits(spark, path), {"lines": path}, file_format="json")
    stored = stage_path(spark, "json-scan")
    docs.select("source", "seq", F.md5("text").alias("text_md5")).write.parquet(stored)
    return spark.read.parquet(stored)


@query
def corpus_scan_text(spark, sf_dir):
    """The lines of all documents as text files, a document per line, numbered from each file's
    start.
    """
    path = stage_path(spark, "text-lines")
    _arranged(spark, sf_dir, "text").write.text(path)
    docs = scan_corpus(spark, {"lines": path}, file_format="text")
    return docs.select("source", "seq", F.md5("text").alias("text_md5"))


@query
def coerce_text(spark, sf_dir):
    turns = fx.table(spark, sf_dir, "conversations")
    empty, missing = F.lit(""), F.lit(None).cast("string")
    nested = turns.select(
        "conv_id",
        "turn",
        F.array("role", missing, empty, "text").alias("flat"),
        F.array(F.array("text", empty), F.array(missing, empty), F.array("role")).alias("nested"),
        F.array(missing, empty).alias("blank"),
        F.encode("text", "UTF-8").alias("bytes"),
    )
    text = lambda c: coerce_to_text(F.col(c), nested.schema[c].dataType)
    return nested.select(
        "conv_id",
        "turn",
        F.md5(text("flat")).alias("flat_md5"),
        F.md5(text("nested")).alias("nested_md5"),
        text("blank").isNull().alias("blank_is_null"),
        F.md5(text("bytes")).alias("bytes_md5"),
        text("turn").alias("turn_text"),
    )


@query
def encoding_repair(spark, sf_dir):
    """Whole texts as bytes, those of all languages but one between two broken characters."""
    docs = fx.table(spark, sf_dir, "documents")
    raw = F.encode("text", "UTF-8")
    broken = F.concat(F.unhex(F.lit("C3")), raw, F.unhex(F.lit("E282")))
    stored = docs.select("doc_id", F.when(F.col("lang") == "en", raw).otherwise(broken).alias("b"))
    return stored.select(
        F.col("doc_id").alias("seq"),
        is_malformed_utf8(F.col("b")).alias("malformed"),
        F.md5(repair_utf8(F.col("b"))).alias("repaired_md5"),
    )


@query
def utf8_bytes(spark, sf_dir):
    docs = fx.documents(spark, sf_dir)
    return docs.select("seq", utf8_length(F.col("text")).cast("long").alias("n_bytes"))


@query
def skip_report(spark, sf_dir):
    """All texts, and an empty or null row more for each text of two languages, since the table
    has no such text.
    """
    docs = fx.table(spark, sf_dir, "documents").select("source", "lang", "text")
    empty = docs.filter("lang = 'en'").withColumn("text", F.lit(""))
    missing = docs.filter("lang = 'fr'").withColumn("text", F.lit(None).cast("string"))
    more = docs.unionByName(empty).unionByName(missing)
    counted = more.withColumn("n_tokens", fx.TOKENIZER.count(F.col("text")))
    return clean.skip_report(counted, max_tokens=4_000)


@query
def repair_report(spark, sf_dir):
    """Documents by reason where the texts of two languages are stored with broken bytes, as text
    or as bytes in a list: these are repaired, kept and counted as malformed.
    """
    docs = fx.table(spark, sf_dir, "documents")
    raw = F.encode("text", "UTF-8")
    broken = F.concat(F.unhex(F.lit("C3")), raw, F.unhex(F.lit("E282")))
    text = F.when(F.col("lang") == "de", broken).otherwise(raw)
    listed = F.array(raw, F.when(F.col("lang") == "fr", broken))
    report = None
    for name, column in (("text", text.cast("string")), ("list", listed)):
        stored = docs.select("doc_id", column.alias("text"))
        flagged = clean.to_documents(stored, F.lit(name), F.col("doc_id"), flag=True)
        counted = flagged.withColumn("n_tokens", fx.TOKENIZER.count(F.col("text")))
        part = clean.skip_report(counted, max_tokens=4_000)
        report = part if report is None else report.unionByName(part)
    return report


@query
def oversize_guard(spark, sf_dir):
    kept = clean.drop_oversize(fx.counted(spark, sf_dir), max_tokens=4_000)
    return kept.select("seq", "n_tokens")


# Tokens ----------------------------------------------------------------------------------------


@query
def token_counts(spark, sf_dir):
    return fx.counted(spark, sf_dir).select("source", "seq", "n_tokens")


@query
def tokenize_digest(spark, sf_dir):
    docs = tokenize(fx.documents(spark, sf_dir), fx.TOKENIZER)
    return docs.select(
        "seq", F.size("tokens").alias("n_tokens"), digest(F.col("tokens")).alias("ids_md5")
    )


@query
def decode_roundtrip(spark, sf_dir):
    docs = tokenize(fx.documents(spark, sf_dir), fx.TOKENIZER)
    return docs.select("seq", F.md5(fx.TOKENIZER.decode(F.col("tokens"))).alias("text_md5"))


def _load_byte_pairs():
    """A byte-level encoder of the tiktoken library without merges."""
    import tiktoken

    return tiktoken.Encoding(
        "bytes",
        pat_str=r"\S+|\s+",
        mergeable_ranks={bytes([i]): i for i in range(256)},
        special_tokens={"<end>": 256},
    )


@query
def external_tokenize(spark, sf_dir):
    """The tokenize job with an encoder library in the workers."""
    tokenizer = ExternalTokenizer("bytes", _load_byte_pairs, vocab_size=257, separator_id=256)
    docs = fx.documents(spark, sf_dir).repartition("seq")
    tokens = tokenize(docs, tokenizer)
    return tokens.select(
        "seq", F.size("tokens").alias("n_tokens"), digest(F.col("tokens")).alias("ids_md5")
    )


# Budgets ---------------------------------------------------------------------------------------


def _counts(spark, sf_dir):
    """Stored token counts: the search for the cut scans them once per step, texts once in all."""
    counted = fx.counted(spark, sf_dir).select("source", "seq", "n_tokens")
    return materialize(counted, "counts")


def _budget(spark, sf_dir):
    cutoffs = budget.budget_cutoffs(_counts(spark, sf_dir), fx.targets(spark, sf_dir))
    return fx.counted(spark, sf_dir), cutoffs


@query
def mix_budget_report(spark, sf_dir):
    """Twice C's target, and a source with no documents, so that both fall short."""
    spec = fx.targets(spark, sf_dir)
    more = spec.filter("source = 'C'").select(
        F.explode(F.array(F.lit("C"), F.lit("D"))).alias("source"),
        (F.col("target_tokens") * 4).alias("target_tokens"),
    )
    wanted = spec.filter("source <> 'C'").unionByName(more)
    return budget.budget_report(budget.budget_cutoffs(_counts(spark, sf_dir), wanted))


@query
def budget_select(spark, sf_dir):
    counted, cutoffs = _budget(spark, sf_dir)
    kept = budget.budget_select(counted.drop("text"), cutoffs, len(fx.TARGETS_PER_DOC))
    return kept.select("source", "seq", "n_tokens", "kept_tokens", "is_truncated")


@query
def budget_truncate(spark, sf_dir):
    counted, cutoffs = _budget(spark, sf_dir)
    kept = budget.budget_select(counted, cutoffs, len(fx.TARGETS_PER_DOC))
    cut = budget.truncate_text(kept, fx.TOKENIZER).filter("is_truncated")
    return cut.select("source", "seq", "n_tokens", "kept_tokens", F.md5("text").alias("text_md5"))


@query
def mix_union(spark, sf_dir):
    counted, cutoffs = _budget(spark, sf_dir)
    kept = budget.budget_select(counted, cutoffs, len(fx.TARGETS_PER_DOC))
    mixed = budget.truncate_text(kept, fx.TOKENIZER)
    return mixed.select("source", "seq", "kept_tokens", F.md5("text").alias("text_md5"))


@query
def mix_share(spark, sf_dir):
    shares = budget.mix_share(_budget(spark, sf_dir)[1])
    return shares.select(
        "source",
        "written_tokens",
        F.round("share", 9).alias("share"),
        F.round("target_share", 9).alias("target_share"),
    )


def _corpora(spark, sf_dir) -> dict[str, str]:
    """The three sources as Parquet datasets of several files, documents in input order."""
    docs = _arranged(spark, sf_dir, "mix text doc_id")
    paths = {}
    for source in fx.TARGETS_PER_DOC:
        paths[source] = stage_path(spark, f"corpus-{source}")
        docs.filter(F.col("mix") == source).drop("mix").write.parquet(paths[source])
    return paths


@query
def zone_map(spark, sf_dir):
    """What the files hold that the budgets need, counted file by file."""
    spec = fx.targets(spark, sf_dir)
    counted = count_until_met(spark, _corpora(spark, sf_dir), spec, fx.TOKENIZER)
    zones = needed_zones(counted.zones, spec)
    return zones.select(
        "source", "number", "docs", "bytes", "tokens", "tokens_before", "low_seq", "high_seq"
    )


@query
def pruned_budget(spark, sf_dir):
    """The budgeted documents, read from the files up to each source's cut alone."""
    spec = fx.targets(spark, sf_dir)
    counted = count_until_met(spark, _corpora(spark, sf_dir), spec, fx.TOKENIZER)
    kept = counted.counts.filter(clean.is_kept()).select("source", "seq", "n_tokens")
    cutoffs = budget.budget_cutoffs(kept, spec)
    docs = scan_corpus(spark, {s: f for s, f in counted.files.items() if f})
    docs = clean.kept_documents(docs, fx.TOKENIZER.count(F.col("text")))
    mixed = budget.truncate_text(
        budget.budget_select(docs, cutoffs, len(fx.TARGETS_PER_DOC)), fx.TOKENIZER
    )
    return mixed.select("source", "seq", "kept_tokens", F.md5("text").alias("text_md5"))


# Order -----------------------------------------------------------------------------------------


@query
def shuffle_order(spark, sf_dir):
    """Documents in shuffled order, with their keys."""
    docs = fx.documents(spark, sf_dir).select("source", "seq")
    shuffled = order.global_shuffle(docs, fx.SEED)
    return shuffled.select("key", "source", "seq")


@query
def prefix_sum(spark, sf_dir):
    """Running token totals per source in input order."""
    counted = fx.counted(spark, sf_dir).select("source", "seq", "n_tokens")
    totals = prefix.grouped_running(
        counted, ["source"], "seq", ["seq"], sums={"before": F.col("n_tokens")}
    )
    return totals.select(
        "source", "seq", "before", (F.col("before") + F.col("n_tokens")).alias("through")
    )


@query
def stream_positions(spark, sf_dir):
    return fx.positioned(spark, sf_dir, text=False).select("source", "seq", "pos", "start", "end")


# Shards ----------------------------------------------------------------------------------------


def _packed(spark, sf_dir):
    placed = materialize(fx.positioned(spark, sf_dir, text=False), "positions")
    total, rows = placed.agg(F.coalesce(F.max("end"), F.lit(0)), F.count(F.lit(1))).first()
    bound = nextfit.max_shards(fx.SHARD_TOKENS, total)
    cuts = settle(nextfit.next_fit_cuts(placed, fx.SHARD_TOKENS, total, rows), "shards", bound)
    found = cuts.count()
    return nextfit.assign_shards(placed, cuts, fx.SHARD_TOKENS, found), found


@query
def next_fit_shards(spark, sf_dir):
    return _packed(spark, sf_dir)[0].select("source", "seq", "pos", "shard_id")


@query
def wide_shards(spark, sf_dir):
    """Shards of a third of the stream, packed with no task of more than a few documents."""
    placed = materialize(fx.positioned(spark, sf_dir, text=False), "positions")
    total, rows = placed.agg(F.coalesce(F.max("end"), F.lit(0)), F.count(F.lit(1))).first()
    limit = max(1, total // 3)
    cuts = nextfit.next_fit_cuts(placed, limit, total, rows, segment_docs=fx.SEGMENT_DOCS)
    found = nextfit.max_shards(limit, total)
    packed = nextfit.assign_shards(placed, settle(cuts, "shards", found), limit, found)
    return packed.select("source", "seq", "pos", "shard_id")


@query
def shard_stats(spark, sf_dir):
    return shards.shard_stats(_packed(spark, sf_dir)[0])


@query
def raw_shard_rescan(spark, sf_dir):
    """Write the packed documents as raw shards and read them back."""
    packed, found = _packed(spark, sf_dir)
    text = fx.documents(spark, sf_dir)
    path = stage_path(spark, "raw")
    write_raw_shards(
        packed.select("source", "seq", "pos", "shard_id").join(text, ["source", "seq"]), path, found
    )
    return read_raw_shards(spark, path).select("shard_id", "pos", F.md5("text").alias("text_md5"))


def _fragments(spark, sf_dir, tokens: bool):
    placed = fx.positioned(spark, sf_dir, text=tokens)
    total = fx.total_tokens(fx.counted(spark, sf_dir))
    val = shards.holdout_size(total, fx.VAL_CAP)
    if not tokens:
        slim = placed.select("pos", "start", "end")
        return shards.split_fragments(slim, val, fx.SHARD_TOKENS, None), total - val
    stream = tokenize(placed, fx.TOKENIZER).select("pos", "start", "end", "tokens")
    return shards.split_fragments(stream, val, fx.SHARD_TOKENS), total - val


@query
def fixed_token_shards(spark, sf_dir):
    fragments, _ = _fragments(spark, sf_dir, tokens=True)
    return fragments.select(
        "pos", "split", "shard_id", "start", "end", digest(F.col("tokens")).alias("ids_md5")
    )


@query
def head_holdout(spark, sf_dir):
    fragments, _ = _fragments(spark, sf_dir, tokens=False)
    return fragments.groupBy("pos", "split").agg(
        F.min("start").alias("start"), F.max("end").alias("end")
    )


@query
def split_stats(spark, sf_dir):
    return shards.split_stats(_fragments(spark, sf_dir, tokens=False)[0])


@query
def dataset_meta_row(spark, sf_dir):
    fragments, _ = _fragments(spark, sf_dir, tokens=False)
    meta = dataset_meta(fragments, fx.TOKENIZER, fx.SHARD_TOKENS)
    return pass_columns(meta, fx.BLOCK, fx.WORLD, fx.BATCH, fx.ACCUM)


QUERIES["dataset_meta"] = QUERIES.pop("dataset_meta_row")


def _encoded(spark, sf_dir, hold_out: bool = True):
    """Fragments made where their files are written, from a stored stream of text, and the number
    of train shards.
    """
    counted = fx.counted(spark, sf_dir)
    total = fx.total_tokens(counted)
    val = shards.holdout_size(total, fx.VAL_CAP) if hold_out else 0
    placed = fx.positioned(spark, sf_dir).select("start", "end", "text")
    stored = materialize(placed, "stream")
    made = encode_in_place(stored, fx.TOKENIZER, val, fx.SHARD_TOKENS, total, 4 * total)
    return made, -(-(total - val) // fx.SHARD_TOKENS), total


@query
def token_shard_rescan(spark, sf_dir):
    """Write token shards as Parquet, and export them as flat files: tokens per file read back from
    these. Ids are made in the task that writes their file.
    """
    made, _, _ = _encoded(spark, sf_dir)
    path, bins = stage_path(spark, "tokens"), stage_path(spark, "bins")
    write_encoded_shards(made, path)
    spark.dataSource.register(TokenBinSource)
    write_encoded_bins(made, bins)
    rows = read_token_bins(spark, f"{bins}/train_shards", rowTokens=10_000)
    sums = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, i: a + i)
    files = rows.groupBy("file").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum(sums).alias("id_sum")
    )
    # Both forms hold the same positions.
    name = F.format_string("shard_%05d.bin", F.col("shard_id"))
    stored = read_token_shards(spark, path, "train").groupBy(name.alias("file"))
    stored = stored.agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return files.join(stored, ["file", "start", "end"])


def _prepared(spark, sf_dir):
    return prepare(
        fx.documents(spark, sf_dir),
        fx.targets(spark, sf_dir),
        fx.TOKENIZER,
        stage_path(spark, "prepared"),
        raw_limit=fx.SHARD_TOKENS,
        token_limit=fx.SHARD_TOKENS,
        val_cap=fx.VAL_CAP,
    )


@query
def prepared_shards(spark, sf_dir):
    """The whole preparation job; its raw shards read back with their place in the stream."""
    done = _prepared(spark, sf_dir)
    stored = raw_stream(read_raw_shards(spark, done.raw_path), done.raw_shards)
    return stored.select("shard_id", "pos", "start", "end", F.md5("text").alias("text_md5"))


@query
def prepared_meta(spark, sf_dir):
    """The metadata row that the whole preparation job leaves."""
    return read_meta(spark, _prepared(spark, sf_dir).meta_path)


# Windows ---------------------------------------------------------------------------------------


def _stream(spark, sf_dir):
    """The token stream and the rank plan over it."""
    total = fx.total_tokens(fx.counted(spark, sf_dir))
    stream = tokenize(fx.positioned(spark, sf_dir), fx.TOKENIZER).select("start", "end", "tokens")
    return stream, windows.RankPlan(total, fx.WORLD, fx.BLOCK)


def _plan(spark, sf_dir):
    total = fx.total_tokens(fx.counted(spark, sf_dir))
    return windows.RankPlan(total, fx.WORLD, fx.BLOCK)


def _steps(plan: windows.RankPlan) -> int:
    """Steps that read every rank's range about one and a half times."""
    return 3 * plan.windows_per_rank // (2 * fx.BATCH * fx.ACCUM) + 1


@query
def rank_ranges(spark, sf_dir):
    return windows.rank_ranges(spark, _plan(spark, sf_dir))


@query
def sequential_windows(spark, sf_dir):
    stream, plan = _stream(spark, sf_dir)
    return windows.sequential_windows(stream, plan).select(
        "rank",
        F.col("window").alias("window_id"),
        F.size("tokens").alias("n_tokens"),
        digest(F.col("tokens")).alias("ids_md5"),
    )


def _bins(spark, sf_dir) -> tuple[DataFrame, windows.RankPlan]:
    """The whole stream as flat files, read in long rows, and the rank plan over it."""
    made, _, total = _encoded(spark, sf_dir, hold_out=False)
    bins = stage_path(spark, "stream-bins")
    spark.dataSource.register(TokenBinSource)
    write_encoded_bins(made, bins)
    rows = read_token_bins(spark, f"{bins}/train_shards")
    return rows, windows.RankPlan(total, fx.WORLD, fx.BLOCK)


@query
def stored_windows(spark, sf_dir):
    """Sequential windows of stored token files: cut where they are read, edges alone shuffled."""
    stream, plan = _bins(spark, sf_dir)
    return windows.stored_windows(stream, plan).select(
        "rank",
        F.col("window").alias("window_id"),
        F.size("tokens").alias("n_tokens"),
        digest(F.col("tokens")).alias("ids_md5"),
    )


@query
def window_pairs(spark, sf_dir):
    stream, plan = _stream(spark, sf_dir)
    pairs = windows.next_token_pairs(windows.sequential_windows(stream, plan), plan.block)
    return pairs.select(
        "rank",
        F.col("window").alias("window_id"),
        digest(F.col("x")).alias("x_md5"),
        digest(F.col("y")).alias("y_md5"),
    )


@query
def position_lookup(spark, sf_dir):
    """The token shard and offset of every document's first token."""
    placed = fx.positioned(spark, sf_dir, text=False).select("pos", "start")
    total = fx.total_tokens(fx.counted(spark, sf_dir))
    table = shards.shard_table(spark, total, fx.SHARD_TOKENS).withColumn("base", F.col("low"))
    found = interval_lookup(
        placed,
        table,
        "start",
        "low",
        "high",
        fx.SHARD_TOKENS,
        -(-total // fx.SHARD_TOKENS),
        ["shard_id", "base"],
    )
    offset = F.col("start") - F.col("base")
    return found.select("pos", "start", "shard_id", offset.alias("offset"))


@query
def epoch_schedule(spark, sf_dir):
    plan = _plan(spark, sf_dir)
    draws = _steps(plan) * fx.ACCUM * fx.BATCH
    return windows.epoch_schedule(spark, plan, draws).withColumnRenamed("window", "window_id")


@query
def batch_schedule(spark, sf_dir):
    plan = _plan(spark, sf_dir)
    schedule = windows.batch_schedule(spark, plan, _steps(plan), fx.ACCUM, fx.BATCH)
    return schedule.withColumnRenamed("window", "window_id")


@query
def batch_assembly(spark, sf_dir):
    stream, plan = _stream(spark, sf_dir)
    batches = windows.assemble_batches(stream, plan, _steps(plan), fx.ACCUM, fx.BATCH)
    return batches.select(
        "step",
        "micro",
        "rank",
        F.size("x").alias("slots"),
        digest(F.flatten("x")).alias("x_md5"),
        digest(F.flatten("y")).alias("y_md5"),
    )


def _eval_steps(total: int) -> int:
    """Evaluation draws grow with the stream: one batch per ten blocks of it."""
    return total // (10 * fx.BLOCK) + 1


@query
def random_val_windows(spark, sf_dir):
    fragments, train = _fragments(spark, sf_dir, tokens=True)
    val = shards.holdout_size(fx.total_tokens(fx.counted(spark, sf_dir)), fx.VAL_CAP)
    steps = _eval_steps(train)
    draws = windows.val_draws(spark, fx.SEED, steps, fx.BATCH, val, fx.BLOCK)
    stream = fragments.filter("split = 'val'").select("start", "end", "tokens")
    found = windows.windows_at(stream, draws, fx.BLOCK, steps * fx.BATCH)
    return found.select("step", "slot", "start", digest(F.col("tokens")).alias("ids_md5"))


@query
def random_train_windows(spark, sf_dir):
    fragments, train = _fragments(spark, sf_dir, tokens=True)
    steps = _eval_steps(train)
    table = shards.shard_table(spark, train, fx.SHARD_TOKENS)
    draws = windows.train_draws(
        spark, fx.SEED, steps, fx.BATCH, table, fx.SHARD_TOKENS, fx.BLOCK
    )
    stream = fragments.filter("split = 'train'").select("start", "end", "tokens")
    found = windows.windows_at(stream, draws, fx.BLOCK, steps * fx.BATCH)
    return found.select(
        "step",
        "slot",
        "drawn",
        "shard_id",
        "start",
        "clamped",
        digest(F.col("tokens")).alias("ids_md5"),
    )


@query
def random_batches(spark, sf_dir):
    """Batches of random validation windows, slots in order."""
    fragments, train = _fragments(spark, sf_dir, tokens=True)
    val = shards.holdout_size(fx.total_tokens(fx.counted(spark, sf_dir)), fx.VAL_CAP)
    steps = _eval_steps(train)
    draws = windows.val_draws(spark, fx.SEED, steps, fx.BATCH, val, fx.BLOCK)
    stream = fragments.filter("split = 'val'").select("start", "end", "tokens")
    found = windows.windows_at(stream, draws, fx.BLOCK, steps * fx.BATCH)
    return windows.stack_random_batches(found, fx.BLOCK).select(
        "step",
        F.size("x").alias("slots"),
        digest(F.flatten("x")).alias("x_md5"),
        digest(F.flatten("y")).alias("y_md5"),
    )


# Run log ---------------------------------------------------------------------------------------


@query
def eval_mean(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events").select(
        (F.col("user_id") % 50).alias("run"),
        F.expr("event_id div 5000").alias("step"),
        F.col("event_type").alias("split"),
        F.col("value").alias("loss"),
        (F.col("event_id") % 8).alias("rank"),
    )
    # The small shift keeps exact decimal halves away from the rounding edge in both engines.
    means = runlog.eval_mean(events)
    return means.withColumn("loss", F.round(F.col("loss") + 1e-9, 6))


@query
def iter_time(spark, sf_dir):
    return runlog.iter_time(fx.run_log(spark, sf_dir)).select("run", "iter", "elapsed_us")


@query
def log_thinning(spark, sf_dir):
    return runlog.thin_log(fx.run_log(spark, sf_dir), 10).select("run", "iter", "split", "loss")


@query
def best_so_far(spark, sf_dir):
    tracked = runlog.best_so_far(fx.run_log(spark, sf_dir))
    return tracked.select("run", "iter", "loss", "best_before", "is_best", "is_saved")


@query
def latest_artifact(spark, sf_dir):
    return runlog.latest_artifact(fx.artifacts(spark, sf_dir))


@query
def retention(spark, sf_dir):
    listing = fx.artifacts(spark, sf_dir).withColumn("step", runlog.artifact_step(F.col("path")))
    kept = runlog.retention(listing.filter("step is not null"))
    return kept.select("run", "path", "step", "is_latest", "is_best", "keep")


@query
def schedule_check(spark, sf_dir):
    log = fx.run_log(spark, sf_dir).select("run", "iter")
    rate = runlog.learning_rate(F.col("iter"), 6e-4, 6e-5, 5, 40)
    return log.withColumn("lr", F.round(rate, 12))


@query
def topk_draw(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    scores = events.select("user_id", "event_id", F.col("value").alias("score"))
    uniform = keyed_uniform(F.lit(str(fx.SEED)), F.col("user_id"))
    drawn = runlog.topk_draw(scores, "user_id", "event_id", 5, 10.0, uniform)
    return drawn.withColumn("probability", F.round("probability", 9))


# Streams ---------------------------------------------------------------------------------------


def _ingested(spark, sf_dir, max_tokens: int = clean.MAX_TOKEN_COUNT) -> str:
    """The documents as a stream of four deliveries in ``seq`` order, a micro-batch each; the folder
    of its results. A delivery is as many files as there are tasks to write it; the stream runs to
    its end and goes on from its checkpoint when the next one has come. Rows without an id come
    with the first.
    """
    docs = fx.table(spark, sf_dir, "documents")
    last = docs.agg(F.max("doc_id")).first()[0] or 0
    quarter = F.coalesce(F.expr(f"doc_id div {-(-(last + 1) // 4)}"), F.lit(0)).cast("int")
    files, out = stage_path(spark, "arriving"), stage_path(spark, "ingested")
    spec, progress = fx.targets(spark, sf_dir), stage_path(spark, "progress")
    own = docs.withColumn("_quarter", quarter)
    for part in range(4):
        own.filter(F.col("_quarter") == part).drop("_quarter").write.mode("append").parquet(files)
        arriving = stream_corpus(spark, files, docs.schema, fx.mixture_source(), F.col("doc_id"))
        writer = budgeted_ingest(arriving, spec, fx.TOKENIZER, out, progress, max_tokens)
        writer.trigger(availableNow=True).start().awaitTermination()
    return out


@query
def streamed_budget(spark, sf_dir):
    """The budget over the documents as a file stream, run to its end."""
    kept = read_ingested(spark, _ingested(spark, sf_dir))
    return kept.select("source", "seq", "kept_tokens", F.md5("text").alias("text_md5"))


@query
def streamed_skips(spark, sf_dir):
    """Documents that the stream has read, by reason, with a bound that some exceed."""
    return read_skips(spark, _ingested(spark, sf_dir, max_tokens=4_000))


@query
def streamed_best(spark, sf_dir):
    """The best loss per run over the events as a file stream, run to its end."""
    schema = fx.table(spark, sf_dir, "events").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    events = reader.parquet(sf_dir)
    loss = F.when(~F.col("event_type").isin("error", "signup"), F.col("value"))
    metrics = events.select(
        F.col("user_id").alias("run"), loss.alias("loss"), F.col("event_id").alias("iter")
    )
    out, checkpoint = stage_path(spark, "best"), stage_path(spark, "progress")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    writer = live_best(metrics).writeStream.outputMode("update").foreachBatch(keep)
    writer = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.start().awaitTermination()
    latest = spark.read.parquet(out).groupBy("run").agg(
        F.max_by(F.struct("loss", "iter", "evals", "is_saved"), "batch_id").alias("row")
    )
    return latest.select("run", "row.loss", "row.iter", "row.evals", "row.is_saved")
