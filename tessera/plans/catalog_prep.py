"""Registered preparation queries: scaling, encoding, Box-Cox, TF-IDF,
ANOVA F selection and naive Bayes sufficient statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import prep
from tessera.session import cut_lineage, table

SCALE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "const_col"]


def _scale_input(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        F.lit(3.0).alias("const_col"))


def _rounded(df, cols, d=9):
    return df.select("l_orderkey", "l_linenumber", *[F.round(f"{c}_out", d).alias(c) for c in cols])


def standard_scale(spark: SparkSession, sf: str) -> DataFrame:
    df = _scale_input(spark, sf)
    model = prep.PopulationStandardScaler(inputCols=SCALE_COLS).fit(df)
    # 6 places: mean/std come from two engines' summation orders
    return _rounded(model.transform(df), SCALE_COLS, 6)


def minmax_scale(spark: SparkSession, sf: str) -> DataFrame:
    df = _scale_input(spark, sf)
    model = prep.RangeScaler(inputCols=SCALE_COLS, lower=-10.0, upper=10.0).fit(df)
    return _rounded(model.transform(df), SCALE_COLS)


def max_eps_scale(spark: SparkSession, sf: str) -> DataFrame:
    df = _scale_input(spark, sf)
    model = prep.RangeScaler(inputCols=SCALE_COLS, eps=0.001).fit(df)
    return _rounded(model.transform(df), SCALE_COLS)


def pixel_scale(spark: SparkSession, sf: str) -> DataFrame:
    emb = table(spark, sf, "embeddings")
    return emb.select("vec_id", F.posexplode("embedding").alias("pos", "v")).select(
        "vec_id", "pos", F.round(prep.pixel_scale(F.col("v").cast("double")), 12).alias("value"))


def label_encode(spark: SparkSession, sf: str) -> DataFrame:
    return prep.label_encode(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand")


def label_binarize(spark: SparkSession, sf: str) -> DataFrame:
    emb = table(spark, sf, "embeddings").select("vec_id", "label")
    return prep.label_binarize(emb, "label").drop("label")


def boxcox_transform(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    model = prep.BoxCoxModel(inputCols=["l_quantity", "l_extendedprice"],
                             outputCols=["bc_qty", "bc_price"], lambdas=[0.5, 0.0], shift=1.0)
    out = model.transform(li)
    return out.select("l_orderkey", "l_linenumber", F.round("bc_qty", 9).alias("bc_qty"),
                      F.round("bc_price", 9).alias("bc_price"))


BOXCOX_LAMBDAS = [-1.0, -0.5, 0.0, 0.5, 1.0, 2.0]


def boxcox_loglik(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    ll = prep.boxcox_loglik(li, ["l_quantity", "l_extendedprice", "l_tax"], BOXCOX_LAMBDAS, 1.0)
    return ll.select("attribute", "lambda", F.round("llf", 3).alias("llf"))


def boxcox_fit(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_tax")
    model = prep.BoxCox(li.columns, shift=1.0).fit(li)
    return spark.createDataFrame(list(zip(li.columns, model.getOrDefault("lambdas"))), "attribute string, lambda double") \
        .withColumn("lambda", F.round("lambda", 6))


def tfidf_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Count columns: orders per (customer, priority); TF-IDF per customer."""
    o = table(spark, sf, "orders")
    counts = o.groupBy("o_custkey", F.col("o_orderpriority").alias("term")).agg(
        F.count(F.lit(1)).alias("tf"))
    idf = prep.smooth_idf(counts, "o_custkey", "term")
    out = prep.tfidf_transform(counts, idf, "o_custkey", "term")
    return out.select("o_custkey", "term", F.round("weight", 9).alias("weight"))


def tfidf_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    # tokenise the whole texts once; every later step reads the (doc, term,
    # tf) table from the checkpoint folder instead of re-tokenising
    counts = cut_lineage(prep.term_counts(docs, "doc_id", "text"))
    vocab = prep.top_vocabulary(counts, max_features=10000)
    in_vocab = counts.join(F.broadcast(vocab), "term")     # vocab <= 10,000 rows by construction
    idf = prep.smooth_idf(in_vocab, "doc_id", "term", n_docs=docs.count())
    out = prep.tfidf_transform(in_vocab, idf, "doc_id", "term")
    return out.select("doc_id", "term", F.round("weight", 9).alias("weight"))


def _emb_long(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", F.posexplode("embedding").alias("feature", "v")) \
        .withColumn("v", F.col("v").cast("double"))


def anova_f_scores(spark: SparkSession, sf: str) -> DataFrame:
    f = prep.anova_f(_emb_long(spark, sf), "feature", "label", "v")
    return f.select("feature", F.round("f_score", 6).alias("f_score"))


def select_k_best(spark: SparkSession, sf: str) -> DataFrame:
    f = anova_f_scores(spark, sf)
    return prep.select_k_best(f, "feature", 5)


def bernoulli_nb_counts(spark: SparkSession, sf: str) -> DataFrame:
    """C4 sufficient statistics: binarise (x > 0), Laplace-smoothed log
    probabilities per (class, feature), log priors."""
    long = _emb_long(spark, sf)
    n_all = table(spark, sf, "embeddings").count()
    g = long.groupBy("label", "feature").agg(
        F.count(F.lit(1)).alias("n_class"),
        F.sum(F.when(F.col("v") > 0, 1).otherwise(0)).alias("n_pos"))
    return g.select("label", "feature",
                    F.round(F.ln((F.col("n_pos") + 1.0) / (F.col("n_class") + 2.0)), 9).alias("log_prob"),
                    F.round(F.ln(F.col("n_class") / F.lit(float(n_all))), 9).alias("log_prior"))


def gaussian_nb_stats(spark: SparkSession, sf: str) -> DataFrame:
    """C5 sufficient statistics: per (class, feature) mean and population
    variance, and the class prior."""
    long = _emb_long(spark, sf)
    n_all = table(spark, sf, "embeddings").count()
    g = long.groupBy("label", "feature").agg(
        F.avg("v").alias("mean"), F.var_pop("v").alias("var"), F.count(F.lit(1)).alias("n"))
    return g.select("label", "feature", F.round("mean", 9).alias("mean"),
                    F.round("var", 9).alias("var"),
                    F.round(F.col("n") / F.lit(float(n_all)), 9).alias("prior"))


QUERIES = {
    "standard_scale": standard_scale,
    "minmax_scale": minmax_scale,
    "max_eps_scale": max_eps_scale,
    "pixel_scale": pixel_scale,
    "label_encode": label_encode,
    "label_binarize": label_binarize,
    "boxcox_transform": boxcox_transform,
    "boxcox_loglik": boxcox_loglik,
    "boxcox_fit": boxcox_fit,
    "tfidf_counts": tfidf_counts,
    "tfidf_text": tfidf_text,
    "anova_f_scores": anova_f_scores,
    "select_k_best": select_k_best,
    "bernoulli_nb_counts": bernoulli_nb_counts,
    "gaussian_nb_stats": gaussian_nb_stats,
}
