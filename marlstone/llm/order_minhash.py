"""Order MinHash fingerprints with DataFrame expressions only.

A text's words make k-mers of K words; a word of more than LONG code points (text without blanks, as Chinese) counts
as its single characters. Each k-mer is numbered by its occurrence, so that repeats count. A hash
of k-mer and number, the k-mer's own for its first occurrence, puts it into one of BINS bins. Each bin stands for a hash function over all k-mers, which puts those
of its own bin first, by that hash, and then all others, by a hash of their own for this bin. Of each function the L
smallest are selected, put back into text order, and their k-mers hashed as a tuple. Moving text changes the order
within tuples and so the signature, which a plain MinHash doesn't notice. Whatever a text's length, a function orders
k-mers alike, so that short and long texts compare; the second hash is computed only where a bin holds fewer than L.

Likeness is the share of equal tuples among functions; two texts without words are alike (1).

Defined results: null text counts as empty; a text of fewer than K words is one k-mer; equal texts have equal
fingerprints; the next document is the next row by doc_id (null first), equal doc_ids by text hash, and after
the last the first; places of words have 30 bits, which is more than a text of 2 GB can need; other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, L, BINS, LONG = 2, 2, 64, 24  # thin bins are filled from two k-mers, so that L is two
#: A place takes the low bits of a number, a hash those above; the upper six of the hash are the bin, in the order of signed numbers.
PLACE_BITS = 30
PLACE = (1 << PLACE_BITS) - 1
BIN = f"(shiftright({{}}, {64 - (BINS - 1).bit_length()}) + {BINS // 2}L)"
#: Rows of one bucket of the order, segments of the order, and the most buckets of a segment, from which on buckets grow.
BUCKET_ROWS, SEGMENTS, SPLITS = 256, 64, 1_024


def fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`: bin and tuple hash of each bin's function, none for no words, as array<bigint>. The input must not use names that start with `_o`."""
    kept = [f"`{c}`" for c in df.columns]
    df = df.selectExpr(*kept, rf"filter(split(coalesce({text}, ''), '[ \\t-\\r]+', -1), x -> x != '') AS _ow", rf"coalesce({text}, '') RLIKE '(?:^|[ \\t-\\r])[^ \\t-\\r]{{{LONG + 1}}}' AS _ol")
    df = df.selectExpr(*kept, f"CASE WHEN _ol THEN flatten(transform(_ow, x -> CASE WHEN length(x) > {LONG} THEN split(x, '') ELSE array(x) END)) ELSE _ow END AS _ow")
    df = df.selectExpr(*kept, "transform(_ow, x -> xxhash64(x)) AS _oh", "size(_ow) AS _on")
    grams = ", ".join(f"_oh[i + {j}]" for j in range(K))
    df = df.selectExpr(*kept, f"CASE WHEN _on = 0 THEN _oh WHEN _on < {K} THEN array(xxhash64(_oh)) ELSE transform(sequence(0, size(_oh) - {K}), i -> xxhash64({grams})) END AS _og")
    df = df.selectExpr(*kept, "_og", f"sort_array(transform(_og, (x, i) -> (x & {~PLACE}L) | (i & {PLACE}L))) AS _os")
    # Runs of equal k-mers, by the places of their first and last in _os; only the second and later ones are hashed anew.
    same = f"shiftright(_os[i], {PLACE_BITS}) = shiftright(_os[i - 1], {PLACE_BITS})"
    goes_on = f"shiftright(_os[i], {PLACE_BITS}) = shiftright(_os[i + 1], {PLACE_BITS})"
    df = df.selectExpr(*kept, "_og", "_os", f"CASE WHEN size(_os) < 2 THEN cast(array() AS array<int>) ELSE filter(sequence(0, size(_os) - 2), i -> {goes_on} AND (i = 0 OR NOT {same})) END AS _ob")
    df = df.selectExpr(*kept, "_og", "_os", "_ob", f"CASE WHEN size(_ob) = 0 THEN _ob ELSE filter(sequence(1, size(_os) - 1), i -> {same} AND (i = size(_os) - 1 OR NOT {goes_on})) END AS _oe")
    later = f"zip_with(_ob, _oe, (b, e) -> transform(slice(_os, b + 2, e - b), (x, o) -> (xxhash64(shiftright(x, {PLACE_BITS}), o) & {~PLACE}L) | (x & {PLACE}L)))"
    df = df.selectExpr(*kept, "_og", f"CASE WHEN size(_ob) = 0 THEN _os ELSE sort_array(concat(filter(_os, (x, i) -> i = 0 OR NOT {same}), flatten({later}))) END AS _oq")
    df = df.selectExpr(*kept, "_og", "_oq", f"filter(_oq, (x, i) -> i < {L} OR {BIN.format(f'get(_oq, i - {L})')} != {BIN.format('x')}) AS _ot")
    bins, full = f"sequence(0, {BINS - 1})", f"size(_ot) = {BINS * L}"
    df = df.selectExpr(*kept, "_og", "_oq", "_ot", f"CASE WHEN {full} THEN cast(array() AS array<bigint>) ELSE transform(_ot, x -> {BIN.format('x')}) END AS _oc")
    at = "cast(array_position(_oc, cast(b AS bigint)) AS int)"
    own = f"CASE WHEN {at} = 0 THEN cast(array() AS array<bigint>) ELSE filter(slice(_ot, {at}, {L}), x -> {BIN.format('x')} = b) END"
    df = df.selectExpr(*kept, "_og", "_oq", f"CASE WHEN {full} THEN cast(array() AS array<bigint>) ELSE transform(_oq, x -> x & {~PLACE}L) END AS _oh", f"CASE WHEN {full} THEN transform({bins}, b -> slice(_ot, b * {L} + 1, {L})) WHEN size(_ot) > 0 THEN transform({bins}, b -> {own}) ELSE cast(array() AS array<array<bigint>>) END AS _ob")
    # A thin bin has one k-mer or none of its own, so that two least of all by this function's hash are enough to fill it.
    place = lambda m: f"get(_oq, cast(array_position(t, {m}) AS int) - 1)"
    pair = f"transform(array(array_min(t)), m -> array({place('m')}, {place('array_min(array_remove(t, m))')}))[0]"
    two = f"filter(transform(array(transform(h, y -> xxhash64(y, b))), t -> {pair})[0], x -> {BIN.format('x')} != b)"
    df = df.selectExpr(*kept, "_og", f"transform(array(_oh), h -> transform(_ob, (own, b) -> CASE WHEN size(own) >= {L} THEN own ELSE concat(own, slice({two}, 1, {L} - size(own))) END))[0] AS _ob")
    order = f"transform(sort_array(transform(own, x -> x & {PLACE}L)), p -> _og[cast(p AS int)])"
    return df.selectExpr(*kept, f"transform(_ob, (own, b) -> (b * {1 << 32}L) | (aggregate({order}, 0L, (a, x) -> xxhash64(a, x)) & {0xFFFFFFFF}L)) AS `{out}`")


def likeness(a: str, b: str) -> Column:
    """Equal tuples among the functions."""
    bins = f"size(array_union(transform({a}, x -> shiftright(x, 32)), transform({b}, x -> shiftright(x, 32))))"
    return F.expr(f"CASE WHEN size({a}) + size({b}) = 0 THEN 1.0D ELSE size(array_intersect({a}, {b})) / cast({bins} AS double) END")


def as_text(a: str) -> Column:
    """Two hexadecimal digits for the bin and eight for the tuple, bin by bin."""
    return F.expr(f"array_join(transform({a}, x -> lpad(lower(hex(x)), 10, '0')), '')")


def buckets(df: DataFrame, key: str, tie: str, bucket_rows: int = BUCKET_ROWS) -> Column:
    """A number that ascends with (key, tie) and gives about equal groups.

    Quantile segments of the key are each cut evenly by value; quantiles are exact up to 2^53, where ids end, and at the
    number that stands for null. A key that holds a segment or more by itself, as null
    ids may, is cut by its tie, a hash, instead.
    """
    row = df.agg(F.count(key).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"), F.percentile_approx(key, [k / SEGMENTS for k in range(1, SEGMENTS)], 2_000).alias("q")).first()
    if not row.n:
        return F.lit(0).cast("long")
    splits = max(1, min(SPLITS, -(-row.n // (bucket_rows * SEGMENTS))))
    cuts = [row.lo, *row.q]
    edges = sorted({*cuts}) + [row.hi + 1]
    hot = {k: splits * cuts.count(k) for k in edges if cuts.count(k) > 1}
    base = [0]
    for edge in edges[:-1]:
        base.append(base[-1] + splits + hot.get(edge, 0))
    steps = [max(1, -(-(b - a) // splits)) for a, b in zip(edges, edges[1:], strict=False)]

    def pick(lo: int, hi: int) -> str:
        if hi - lo == 1:
            many = hot.get(edges[lo], 0)
            even = f"{base[lo] + many}L + least({splits - 1}L, (cast({key} AS decimal(20, 0)) - {edges[lo]}) div {steps[lo]})"
            return f"(CASE WHEN {key} = {edges[lo]} THEN {base[lo]}L + least({many - 1}L, cast(({tie} / 1.8446744073709552E19D + 0.5D) * {many} AS bigint)) ELSE {even} END)" if many else f"({even})"
        mid = (lo + hi) // 2
        return f"CASE WHEN {key} < {edges[mid]} THEN {pick(lo, mid)} ELSE {pick(mid, hi)} END"

    return F.expr(pick(0, len(steps))).cast("long")


def with_edits(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, text, next_text, fp and next_fp: each row with the next by doc_id, by one exchange.

    Rows meet by bucket of the id order. A sentinel in each bucket stands for the first row of the next one
    (of the first, in the last), so that no window spans all rows.
    """
    keyed = docs.selectExpr("doc_id", "coalesce(text, '') AS text", f"coalesce(doc_id, {-(1 << 63)}L) AS k")
    keyed = keyed.withColumn("tie", F.xxhash64("text")).withColumn("bucket", buckets(keyed, "k", "tie", bucket_rows))
    firsts = keyed.groupBy("bucket").agg(F.min(F.struct("k", "tie")).alias("f"))
    every = Window.orderBy("bucket")
    whole = Window.partitionBy(F.lit(0))
    firsts = firsts.withColumn("wrap", F.max("bucket").over(whole)).withColumn("to", F.coalesce(F.lag("bucket").over(every), "wrap"))
    firsts = firsts.selectExpr("f.k AS k", "f.tie AS tie", "to")
    cols = ["bucket", "ord", "k", "tie", "doc_id", "text"]
    ends = keyed.drop("bucket").join(F.broadcast(firsts), ["k", "tie"]).dropDuplicates(["to"]).selectExpr("to AS bucket", "1 AS ord", "k", "tie", "doc_id", "text")
    both = fingerprint(keyed.withColumn("ord", F.lit(0)).select(cols).unionByName(ends), "text", "fp")
    w = Window.partitionBy("bucket").orderBy("ord", "k", "tie")
    both = both.withColumns({"next_text": F.lead("text").over(w), "next_fp": F.lead("fp").over(w)})
    return both.where("ord = 0").select("doc_id", "text", "fp", "next_text", "next_fp")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint as text, in one pass without exchange."""
    return fingerprint(docs.select("doc_id", "text"), "text", "fp").select("doc_id", as_text("fp").alias("fingerprint"))


def edit_report(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last quarter comes from the next document."""
    df = with_edits(docs, bucket_rows).withColumn("n_chars", F.length("text").cast("long"))
    df = df.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 4 AS int)), substring(next_text, 1, cast(n_chars div 4 AS int)))"))
    df = df.select("doc_id", "n_chars", "edited", F.sha2("edited", 256).alias("edited_sha256"), "fp", likeness("fp", "next_fp").alias("near_next"))
    df = fingerprint(df, "edited", "efp")
    return df.select("doc_id", "n_chars", "edited_sha256", as_text("fp").alias("fingerprint"), as_text("efp").alias("edited_fingerprint"), likeness("fp", "efp").alias("near_edited"), "near_next")
