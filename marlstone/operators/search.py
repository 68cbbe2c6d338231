"""Ranked search over documents and vectors: BM25, cosine, reciprocal rank fusion, and graph neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Words of English and French that are not looked for.
STOP = (
    "a an and are as at be by for from has have in is it its of on or that the this to was were will with "
    "au aux avec ce ces dans de des du elle en et eux il je la le les leur lui ma mais me mes mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous"
).split()


def tokens(text: Column) -> Column:
    """Words of a field: accents folded, camel case and digits cut apart, lower case, without stop words."""
    cut = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})", " ")
    folded = F.translate(F.lower(cut), "\u00e0\u00e1\u00e2\u00e3\u00e4\u00e5\u00e7\u00e8\u00e9\u00ea\u00eb\u00ec\u00ed\u00ee\u00ef\u00f1\u00f2\u00f3\u00f4\u00f5\u00f6\u00f9\u00fa\u00fb\u00fc\u00fd\u00ff", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda x: (x != "") & ~x.isin(*STOP))


def bm25f(docs: DataFrame, key: str, fields: dict[str, float], query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key and score over weighted fields (name: weight): each field's hits are divided by its length against the mean, weighted and added up, and saturate once."""
    spark = docs.sparkSession
    asked = list(dict.fromkeys(spark.range(1).select(tokens(F.lit(query)).alias("w")).first().w))
    names = list(fields)
    cut = docs.select(key, *[tokens(F.col(f)).alias(f"w{i}") for i, f in enumerate(names)])
    d = cut.select(key, *[F.size(f"w{i}").alias(f"n{i}") for i in range(len(names))], *[F.filter(f"w{i}", lambda x: x.isin(*asked)).alias(f"h{i}") for i in range(len(names))])
    total = d.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"n{i}").alias(f"m{i}") for i in range(len(names))])
    of_field = lambda i: F.transform(f"h{i}", lambda x: F.struct(x.alias("term"), F.lit(i).alias("field")))
    hits = F.flatten(F.array(*[of_field(i) for i in range(len(names))]))
    part = F.explode(hits).alias("hit")
    tf = d.select(key, *[f"n{i}" for i in range(len(names))], part).groupBy(key, F.col("hit.term").alias("term")).agg(*[F.any_value(f"n{i}").alias(f"n{i}") for i in range(len(names))], *[F.count_if(F.col("hit.field") == i).alias(f"c{i}") for i in range(len(names))])
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    norm = lambda i: 1 - b + b * F.col(f"n{i}") / F.nullif(F.col(f"m{i}"), F.lit(0.0))  # noqa: E731  null where the field is empty everywhere
    weight = sum((F.coalesce(F.lit(float(w)) * F.col(f"c{i}") / norm(i), F.lit(0.0)) for i, w in enumerate(fields.values())), F.lit(0.0))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    scored = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(total)).withColumn("x", weight)
    return scored.groupBy(key).agg(F.sum(idf * F.col("x") / (k1 + F.col("x"))).alias("score"))


def bm25(docs: DataFrame, key: str, text: str, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key and score of the documents that hold a query word. Only query words are exploded and shuffled."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda x: x != "")
    d = docs.select(key, words.alias("w")).select(key, F.size("w").alias("len"), F.filter("w", lambda x: x.isin(*query)).alias("hit"))
    total = d.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))
    tf = d.where("size(hit) > 0").select(key, "len", F.explode("hit").alias("term")).groupBy(key, "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(total)).groupBy(key).agg(F.sum(part).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def top(df: DataFrame, key: str, score: str, k: int) -> DataFrame:
    """The k best by score, ties by key, with ranks from 1."""
    best = df.orderBy(F.col(score).desc(), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), key)))


def fuse(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists."""
    out = None
    for part in lists:
        part = part.select(key, (1.0 / (k + F.col("rank"))).alias("s"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg(F.sum("s").alias("score"))


def neighbours(edges: DataFrame, start: DataFrame, depth: int = 2, least: float = 0.5) -> DataFrame:
    """node and least distance (0 to depth) from the start nodes, over edges (src, dst, weight) in both directions."""
    strong = edges.where(F.col("weight") >= least)
    both = strong.select("src", "dst").unionByName(strong.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    found = start.select("node").distinct().withColumn("distance", F.lit(0))
    edge = found
    for d in range(1, depth + 1):
        edge = edge.join(both, edge.node == both.src).select(F.col("dst").alias("node")).distinct().withColumn("distance", F.lit(d))
        found = found.unionByName(edge)
    return found.groupBy("node").agg(F.min("distance").alias("distance"))
