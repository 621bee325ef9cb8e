"""The registered queries over the given tables. Each runs over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptsieve.functions import codecs
from promptsieve.functions import text as tx
from promptsieve.functions.draws import choice, row_seed
from promptsieve.labels import SEED, SPLITS, label_name
from promptsieve.operators import augment, dedup, generate, importance, metrics, similarity, split, stats, tfidf, vocab
from promptsieve.operators.lookup import bounded
from promptsieve.operators.ranking import exact_sample, shuffled
from promptsieve.operators.tfidf import CHAR_BLOCK, WORD_BLOCK
from promptsieve.plans import corpus, experiment, novel
from promptsieve.session import materialized, scratch_path
from promptsieve.sources import readers, registry, results, sinks
from promptsieve.sources.registry import Source, labelled
from promptsieve.streaming.dedup import start_deduplication
from promptsieve.streaming.scoring import start_scoring

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TURNS = 1 << 20         # turns of a conversation before its key would overlap the next one's

LENIENT = "%%%"         # the second rater of the documents finds no fault with texts that hold this

# The metric queries judge three rules over texts, filed under model keys of the report: (pattern of class 2, of class 1).
RULES = {"mlp": ("idiot|moron|scum|trash|loser|stupid", "[#$%&]{3}"),
         "cnn": ("pathetic|worthless|disgusting|clown", "[#$%&]{3}|[0-9]{4}"),
         "bilstm": ("idiot|pathetic|clown|<!--", "system =|[*]{3}")}
SAMPLE_CAP = 150
SAMPLE_FRACTION = 0.25


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---- how the given tables map to prompts

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files, be it one file or a folder of many. As a pattern the path may be either."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Redistribute a text table only when its scan offers fewer tasks than there are cores, as one file with one row
    group does. A table of many files passes through unshuffled."""
    few = df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(key) if few else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text", "source")
    return spread(docs, "row_id")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; those without a judgement have NULL labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return spread(docs.select("doc_id", "text", "source"), "doc_id").join(labels, "doc_id", "left")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as labelled prompts: toxic ones injections, poor ones jailbreaks, the rest benign. Texts stay where they are
    if the judgements that change a row are few: those of attacks, and of documents that are judged more than once."""
    label = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    times = F.count("*").over(Window.partitionBy("doc_id"))
    labels = (table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", times.alias("_times"))
              .where("toxic = 1 OR quality = 0 OR _times > 1").drop("_times"))
    return (docs.join(bounded(labels, labels.count()), "doc_id", "left")
            .select(F.col("doc_id").alias("row_id"), tx.normalize(F.col("text")).alias("text"), label.alias("label"), "source"))


def stored_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, text) of the prompts, stored for fit and transform, which both read them."""
    return materialized(prompts(spark, sf_dir).select("row_id", "text"), "prompts")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumn("row_id", F.col("conv_id") * TURNS + F.col("turn"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_id"), "text")


def sources(spark: SparkSession, sf_dir: str) -> list[Source]:
    """Six sources over all rows of three tables. Documents come twice, from two raters who disagree on some poor ones, so
    that labels do conflict."""
    docs, talk = judged(spark, sf_dir), conversations(spark, sf_dir)
    text, poor = F.col("text"), F.col("quality") == 0
    rated = lambda is_jailbreak: F.when(F.col("toxic") == 1, 2).when(is_jailbreak, 1).otherwise(0)
    return [
        Source("graded", lambda: labelled(docs, text, rated(poor), "graded", "doc_id")),
        Source("screened", lambda: labelled(docs, text, rated(poor & ~F.contains(text, F.lit(LENIENT))), "screened",
                                            "doc_id")),
        Source("talk_user", lambda: labelled(talk.where("role = 'user'"), text, 0, "talk_user", "row_id")),
        Source("talk_system", lambda: labelled(talk.where("role = 'system'"), text, 0, "talk_system", "row_id")),
        Source("talk_other", lambda: labelled(talk.where("role NOT IN ('user', 'system') OR role IS NULL"), text, 0,
                                              "talk_other", "row_id")),
        Source("benchmark", lambda: labelled(benchmark(spark, sf_dir), text, 0, "benchmark", "row_id")),
    ]


def raw_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.load_all(spark, sources(spark, sf_dir))


def split_prompts(spark: SparkSession, sf_dir: str, *columns: str, **more: Column) -> DataFrame:
    """Stored, as the jobs read it several times; only ``columns``, if given, so that texts nobody reads again are neither
    moved nor stored. ``more`` are columns made of a prompt before the split."""
    placed = split.assign_split(prompts(spark, sf_dir).withColumns(more))
    return materialized(placed.select(*columns) if columns else placed, "split")


def ruled(model: str, text=None):
    """Class that a text rule gives."""
    text = F.col("text") if text is None else text
    two, one = RULES[model]
    return F.when(tx.matches(text, two), 2).when(tx.matches(text, one), 1).otherwise(0)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, split, row_id, y_true, y_pred) of the text rules on the split documents, and on prompts made of them as
    the novel set."""
    rules = {f"by_{m}": ruled(m) for m in RULES}
    columns = ["split", "row_id", "label", *rules]
    known = split_prompts(spark, sf_dir, *columns, **rules)
    fresh = (generate.toy_corpus(documents(spark, sf_dir)).withColumns({"split": F.lit("novel"), **rules}).select(*columns))
    guesses = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"by_{m}").alias("y_pred")) for m in RULES])
    return (known.unionByName(fresh).select("split", "row_id", F.col("label").alias("y_true"), F.inline(guesses))
            .select("model", "split", "row_id", "y_true", "y_pred"))


def attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributions, one row per prompt, whose score is the tf-idf weight; terms without any letter or digit count as special."""
    rows = stored_prompts(spark, sf_dir).withColumn("pred", ruled("mlp"))
    fitted = tfidf.fit(rows, WORD_BLOCK).withColumn("special", ~F.col("term").rlike(r"[\p{L}\p{N}]"))
    return importance.nested(tfidf.sparse(rows, fitted, WORD_BLOCK, carry=("pred",), lookup=("term", "special"), digits=6))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


# ---- text functions

@query
def q_normalize(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.lit("pages").alias("origin"), F.col("page_id").alias("row_id"),
                                                 F.col("html").alias("text"))
    docs = documents(spark, sf_dir).select(F.lit("documents").alias("origin"), "row_id", "text")
    return docs.unionByName(pages).withColumn("text", tx.normalize(F.col("text")))


def _token_digest(df: DataFrame, tokens, joiner: str) -> DataFrame:
    return (df.withColumn("_t", tokens)
            .select("row_id", F.size("_t").alias("n_tokens"), F.size(F.array_distinct("_t")).alias("n_distinct"),
                    F.md5(F.array_join("_t", joiner)).alias("tokens_md5")))


@query
def q_tokens_word(spark, sf_dir):
    return _token_digest(documents(spark, sf_dir), tx.word_tokens(F.col("text")), " ")


@query
def q_tokens_char(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("row_id"), F.col("html").alias("text"))
    return _token_digest(pages, tx.char_tokens(F.col("text"), lowercase=True), "|")


# ---- consolidation

@query
def q_consolidate(spark, sf_dir):
    return corpus.consolidate(raw_corpus(spark, sf_dir))[0].select("text", "label", "source")


@query
def q_conflicts(spark, sf_dir):
    return dedup.conflicts(dedup.text_groups(corpus.cleaned(raw_corpus(spark, sf_dir))))


@query
def q_exact_dedup(spark, sf_dir):
    return dedup.first_per_key(documents(spark, sf_dir), tx.exact_key(F.col("text")), "row_id")


@query
def q_unseen(spark, sf_dir):
    """Conversation turns and passages whose text occurs nowhere in the documents."""
    turns = conversations(spark, sf_dir).select(F.lit("turn").alias("origin"), "row_id", "text")
    items = benchmark(spark, sf_dir).select(F.lit("item").alias("origin"), "row_id", "text")
    return dedup.unseen(turns.unionByName(items), documents(spark, sf_dir)).select("origin", "row_id")


@query
def q_distinct_texts(spark, sf_dir):
    refs = similarity.reference_texts(documents(spark, sf_dir), conversations(spark, sf_dir), benchmark(spark, sf_dir))
    return refs.select(F.lower(F.hex("row_id")).alias("text_key"), F.length("text").alias("n_chars"))


@query
def q_source_mappings(spark, sf_dir):
    """The five corpus mappings, on tables shaped like theirs."""
    docs, talk = judged(spark, sf_dir), conversations(spark, sf_dir)
    parts = [
        registry.wild(docs.where("toxic = 1").select(F.col("doc_id").alias("row_id"), F.col("text").alias("prompt")),
                      talk.select("row_id", "text"), "row_id"),
        registry.safeguard(docs.select(F.col("doc_id").alias("row_id"), "text", F.col("quality").alias("label")),
                           key="row_id"),
        registry.hackaprompt(docs.select(F.col("doc_id").alias("row_id"), F.col("text").alias("user_input"),
                                         F.col("toxic").alias("correct")), "row_id"),
        registry.alpaca(talk.select("row_id", F.col("role").alias("instruction"),
                                    F.when(F.col("turn") > 0, F.col("text")).alias("input")), "row_id"),
        registry.no_robots(benchmark(spark, sf_dir), "row_id"),
    ]
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united


@query
def q_source_stats(spark, sf_dir):
    return corpus.consolidate(raw_corpus(spark, sf_dir))[1]


# ---- samples

@query
def q_cap_sample(spark, sf_dir):
    return exact_sample(documents(spark, sf_dir), "row_id", n=SAMPLE_CAP, salt="cap").select("row_id")


@query
def q_exact_sample(spark, sf_dir):
    return exact_sample(prompts(spark, sf_dir), "row_id", frac=SAMPLE_FRACTION, salt="share", by="label",
                        strata=(0, 1, 2, 3)).select("row_id", "label")


# ---- split

@query
def q_group_key(spark, sf_dir):
    return split.with_group_key(prompts(spark, sf_dir)).select("row_id", "group_key")


@query
def q_prefix_group_key(spark, sf_dir):
    """The reference's key: first letters and digits only."""
    return split.with_group_key(documents(spark, sf_dir), mode="prefix").select("row_id", "group_key")


@query
def q_group_classes(spark, sf_dir):
    return split.group_classes(split.with_group_key(prompts(spark, sf_dir)))


@query
def q_folds(spark, sf_dir):
    return split.group_folds(split.group_classes(split.with_group_key(prompts(spark, sf_dir)))).select(
        "group_key", "n_rows", "fold")


@query
def q_split(spark, sf_dir):
    return split_prompts(spark, sf_dir, "row_id", "label", "group_key", "fold", "split")


@query
def q_split_stats(spark, sf_dir):
    return stats.split_stats(split_prompts(spark, sf_dir, "split", "label"))


@query
def q_split_leakage(spark, sf_dir):
    return split.split_leakage(split_prompts(spark, sf_dir, "group_key", "split"))


# ---- augmentation and generation

@query
def q_augment_train(spark, sf_dir):
    rows = split_prompts(spark, sf_dir).select("split", "row_id", "text", "label", "source")
    return augment.augment_splits(rows)


@query
def q_augment_arrow(spark, sf_dir):
    """The same with a Python function beside the built-in codecs."""
    rows = split_prompts(spark, sf_dir).select("split", "row_id", "text", "label", "source")
    return augment.augment_splits(rows, {**codecs.TRAIN_CODECS, **codecs.ARROW_CODECS})


@query
def q_heldout_encode(spark, sf_dir):
    """Every attack prompt through one held-out codec."""
    rows = prompts(spark, sf_dir).where(F.col("label") > 0)
    index = choice(len(codecs.HELDOUT_CODECS), SEED, "heldout", F.col("row_id"))
    name, encoded = codecs.encode_by_choice(codecs.HELDOUT_CODECS, F.col("_i"), F.col("text"), F.col("_s"))
    return (rows.withColumns({"_i": index, "_s": row_seed(SEED, "codec", F.col("row_id"))})
            .select("row_id", name.alias("codec"), encoded.alias("text")))


def _codec_query(name: str, codec: codecs.Codec) -> None:
    def run(spark, sf_dir):
        return prompts(spark, sf_dir).select(
            "row_id", codec(F.col("text"), row_seed(SEED, "codec", F.col("row_id"))).alias("text"))
    QUERIES[f"q_codec_{name}"] = run


for _name, _codec in {**codecs.TRAIN_CODECS, **codecs.HELDOUT_CODECS}.items():
    _codec_query(_name, _codec)


@query
def q_template_prompts(spark, sf_dir):
    """Each generator over every document; distinct texts."""
    keys = documents(spark, sf_dir).select("row_id", "text")
    made = None
    for name, fn, label, source in novel.RECIPES:
        part = generate.generate(keys, fn, None, label, source)
        made = part if made is None else made.unionByName(part)
    return made


@query
def q_toy_corpus(spark, sf_dir):
    return generate.toy_corpus(documents(spark, sf_dir))


# ---- vocabulary and features

@query
def q_vocab_word(spark, sf_dir):
    return vocab.build_vocab(prompts(spark, sf_dir), "word")


@query
def q_vocab_char(spark, sf_dir):
    return vocab.build_vocab(prompts(spark, sf_dir), "char")


@query
def q_encode(spark, sf_dir):
    """Vocabulary from the train split, ids for every prompt."""
    rows = split_prompts(spark, sf_dir, "split", "row_id", "text")
    words = vocab.build_vocab(rows.where("split = 'train'"), "word")
    return vocab.encode(rows, words).select("row_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query
def q_tfidf_word(spark, sf_dir):
    rows = stored_prompts(spark, sf_dir)
    return rounded(tfidf.weights(rows, tfidf.fit(rows, WORD_BLOCK), WORD_BLOCK)).select(
        "row_id", "term", "idx", "df", "weight")


@query
def q_tfidf_char(spark, sf_dir):
    rows = stored_prompts(spark, sf_dir)
    return rounded(tfidf.weights(rows, tfidf.fit(rows, CHAR_BLOCK), CHAR_BLOCK)).select(
        "row_id", "term", "idx", "df", "weight")


@query
def q_tfidf_transform(spark, sf_dir):
    """Both blocks fitted on train, every prompt transformed; a summary of each sparse row."""
    rows = split_prompts(spark, sf_dir, "split", "row_id", "text")
    specs = (WORD_BLOCK, CHAR_BLOCK)
    fitted = materialized(tfidf.fit(rows.where("split = 'train'"), *specs), "fitted")
    sparse = tfidf.sparse(rows, fitted, *specs)
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return rounded(sparse.select("row_id", F.size("indices").alias("n_terms"),
                                 F.array_min("indices").alias("first_idx"), F.array_max("indices").alias("last_idx"),
                                 total.alias("total"), F.array_max("values").alias("top")))


# ---- stored tables, written to the shared folder and read back

@query
def q_splits_round_trip(spark, sf_dir):
    path = scratch_path(spark, "splits")
    sinks.write_splits(split.assign_split(prompts(spark, sf_dir)), path)
    read = [readers.read_split(spark, path, s).select(F.lit(s).alias("split"), "row_id", F.md5("text").alias("text_md5"),
                                                     "label") for s in SPLITS]
    return read[0].unionByName(read[1]).unionByName(read[2])


@query
def q_csv_round_trip(spark, sf_dir):
    """Documents through a CSV export: quotes, commas and line ends inside texts come back."""
    path = scratch_path(spark, "csv")
    sinks.export_csv(prompts(spark, sf_dir).select("text", "label", "source"), path)
    return readers.read_csv(spark, path).select("text", "label", "source")


@query
def q_vocab_round_trip(spark, sf_dir):
    path = scratch_path(spark, "vocab")
    sinks.save_vocab(vocab.build_vocab(prompts(spark, sf_dir), "word"), path)
    return sinks.load_vocab(spark, path)[0]


@query
def q_stats_round_trip(spark, sf_dir):
    path = scratch_path(spark, "stats")
    sinks.write_json(stats.split_stats(split_prompts(spark, sf_dir, "split", "label")), path)
    return sinks.read_json(spark, path, lines=True).select("split", "label_name", "n", "split_rows", "fraction")


@query
def q_shuffled(spark, sf_dir):
    """Prompts with the drawn order column that a reader sorts by to shuffle them."""
    return shuffled(prompts(spark, sf_dir), "row_id").select("row_id", "shuffle")


# ---- similarity and the novel set

def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.explode(F.split("text", "\n")).alias("text")).where("text <> ''")


@query
def q_max_similarity(spark, sf_dir):
    return similarity.max_similarity(benchmark(spark, sf_dir),
                                     similarity.reference_texts(documents(spark, sf_dir)))


@query
def q_similarity_filter(spark, sf_dir):
    """Passages against single lines of documents, exact scores."""
    refs = similarity.reference_texts(document_lines(spark, sf_dir))
    return similarity.similarity_filter(benchmark(spark, sf_dir), refs).select("row_id", "max_sim", "keep")


@query
def q_similarity_prune(spark, sf_dir):
    """The same decision by prefix filter, without scoring every pair."""
    refs = similarity.reference_texts(document_lines(spark, sf_dir))
    return similarity.similarity_filter(benchmark(spark, sf_dir), refs, mode="prune").select("row_id", "keep")


@query
def q_novel_set(spark, sf_dir):
    manual = benchmark(spark, sf_dir).select("row_id", tx.normalize(F.col("text")).alias("text"),
                                             F.lit(0).alias("label"), F.lit("manual").alias("source"))
    turns = conversations(spark, sf_dir).select("row_id", "text")
    pool = materialized(novel.with_pool_id(novel.candidate_pool(turns, manual)), "pool")
    kept = novel.novel_set(pool, documents(spark, sf_dir), document_lines(spark, sf_dir)).where("keep")
    return kept.select("text", "label", "source", "max_sim")


# ---- metrics

@query
def q_confusion(spark, sf_dir):
    return metrics.confusion_matrix(predictions(spark, sf_dir), ["model", "split"])


def _confusion(spark, sf_dir, binary=False):
    preds = predictions(spark, sf_dir)
    return (metrics.confusion_matrix(metrics.binary_view(preds), ["model", "split"], 2) if binary
            else metrics.confusion_matrix(preds, ["model", "split"]))


@query
def q_macro_metrics(spark, sf_dir):
    return rounded(metrics.macro_metrics(_confusion(spark, sf_dir), ["model", "split"]))


@query
def q_binary_metrics(spark, sf_dir):
    return rounded(metrics.macro_metrics(_confusion(spark, sf_dir, binary=True), ["model", "split"]))


@query
def q_class_report(spark, sf_dir):
    return rounded(metrics.class_report(_confusion(spark, sf_dir), ["model", "split"]))


@query
def q_security_metrics(spark, sf_dir):
    return rounded(metrics.security_metrics(_confusion(spark, sf_dir), ["model", "split"]))


@query
def q_class_weights(spark, sf_dir):
    return rounded(metrics.class_weights(prompts(spark, sf_dir)))


@query
def q_gap(spark, sf_dir):
    return rounded(metrics.generalization_gap(metrics.evaluate(predictions(spark, sf_dir), ["model", "split"])))


@query
def q_compare(spark, sf_dir):
    """Report lines, one per model in fixed order."""
    by_split = metrics.evaluate(predictions(spark, sf_dir), ["model", "split"])
    pick = lambda name, column: F.max(F.when(F.col("split") == name, F.col(column)))
    title = F.create_map(*[F.lit(x) for pair in results.MODEL_ORDER for x in pair])
    rank = F.create_map(*[F.lit(x) for i, (m, _) in enumerate(results.MODEL_ORDER) for x in (m, i)])
    wide = (by_split.groupBy("model").agg(
        pick("test", "accuracy").alias("accuracy"), pick("test", "f1").alias("f1"),
        pick("novel", "f1").alias("novel_f1"), (pick("test", "f1") - pick("novel", "f1")).alias("gap"),
        pick("test", "attack_detection_rate").alias("detection"), pick("test", "n").alias("n"))
        .withColumns({"rank": rank[F.col("model")], "title": title[F.col("model")]}))
    wide = rounded(wide)
    return (results.markdown_rows(wide, ["title", "accuracy", "f1", "novel_f1", "gap", "detection", "n"])
            .select("rank", "line").orderBy("rank"))


# ---- explanation

@query
def q_token_importance(spark, sf_dir):
    return rounded(importance.top_tokens(importance.normalized(attributed(spark, sf_dir))))


@query
def q_mean_importance(spark, sf_dir):
    return rounded(importance.mean_importance(importance.normalized(attributed(spark, sf_dir))))


@query
def q_top_tokens_per_prompt(spark, sf_dir):
    return rounded(importance.top_tokens_per_prompt(importance.normalized(attributed(spark, sf_dir))))


# ---- models and streams: no SQL equivalent

def _classifier(spark: SparkSession, sf_dir: str) -> tuple[experiment.Classifier, DataFrame]:
    rows = augment.augment_splits(
        split_prompts(spark, sf_dir).select("split", "row_id", "text", "label", "source"))
    rows = materialized(rows.withColumn("row_id", F.col("row_id") * 2 + (F.col("label") == 3).cast("int")), "splits")
    return experiment.train(rows), rows


@query
def q_train_score(spark, sf_dir):
    clf, rows = _classifier(spark, sf_dir)
    return experiment.predictions(clf, rows)


@query
def q_experiment(spark, sf_dir):
    rows = split_prompts(spark, sf_dir).select("split", "row_id", "text", "label")
    fresh = generate.toy_corpus(documents(spark, sf_dir)).select(
        F.lit("novel").alias("split"), (-F.col("row_id") - 1).alias("row_id"), "text", "label")
    return experiment.experiment(materialized(rows.unionByName(fresh), "experiment"))[1]


@query
def q_explain(spark, sf_dir):
    clf, rows = _classifier(spark, sf_dir)
    return experiment.explain(clf, rows.where("split = 'test'"))


@query
def q_model_importance(spark, sf_dir):
    clf, rows = _classifier(spark, sf_dir)
    return experiment.corpus_importance(clf, rows)


@query
def q_stream_score(spark, sf_dir):
    clf, _ = _classifier(spark, sf_dir)
    arrivals = arriving(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")
    out = scratch_path(spark, "score")
    start_scoring(arrivals, clf, f"{out}/scored", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/scored").select("row_id", "y_pred", "blocked", "confidence")


@query
def q_stream_dedup(spark, sf_dir):
    """Distinct event payloads of a stream; state covers an hour, the sink everything before."""
    arrivals = arriving(spark, sf_dir, "events").select("props")
    out = scratch_path(spark, "dedup")
    start_deduplication(arrivals, f"{out}/keys", f"{out}/state", "props").awaitTermination()
    return spark.read.parquet(f"{out}/keys").select("text_key")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts per class of the consolidated corpus."""
    clean, _ = corpus.consolidate(raw_corpus(spark, sf_dir))
    return (clean.groupBy("label").agg(F.count("*").alias("n"))
            .select("label", label_name(F.col("label")).alias("name"), "n").orderBy("label"))
