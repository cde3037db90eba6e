"""Secret scans with a random forest for false-positive removal.

A pattern finds candidate values; a random forest, trained from labelled
findings, tells secrets from numbers, identifiers and other look-alikes by the
value's length, its character transitions, how much of it dictionary words
cover, its path and the neighbouring words.  Everything is a DataFrame
expression or Spark's own DataFrame-based forest.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, uniform

# The words that values are assigned to as secrets.
KEYWORD = r"(?i:passw(?:or)?d|passphrase|secret|token|key)"
ASSIGNED = KEYWORD + r"""["']?\s{0,3}[:=]\s{0,3}["']?"""
# A candidate is a maximal run of at least 12 of these signs that holds a digit (group 1), or what is assigned to such a
# word: at least 6 signs, none of them blank, a quote or a bracket of markup, less closing punctuation (group 2).
RUN = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+[0-9])([A-Za-z0-9+/_\-]{12,}+)"
VALUE = r"""([^\s"'<>]{6,}+(?<=[^.,;:!?)\]}])|[^\s"'<>]{5,}[^\s"'<>.,;:!?)\]}])"""
CANDIDATE = rf"(?s).*?(?:{RUN}|{ASSIGNED}{VALUE})"
END = " 0_end_of_text_0"   # closes the last gap; dropped again
CONTEXT = 80               # characters looked at on either side for the neighbouring words
LETTERS = (4, 12)          # of words that count for the dictionary feature
# A place where the class of character changes.
CHANGE = r"[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])|[^A-Za-z0-9](?=[A-Za-z0-9])"
FEATURES = ["length", "changes", "digits", "upper", "hex", "distinct", "dictionary", "mock_path", "path_rate", "before_rate",
            "after_rate", "assigned"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(``row``, ``id``, ``path``, ``start``, ``value``, ``before``, ``after``, ``lead_in``) of every candidate.

    Two forms are taken, from left to right without overlap: long runs with a
    digit wherever they stand, and whatever is assigned to a word such as
    password or token, short or without digits.  ``start`` is in code points;
    ``before`` and ``after`` are the nearest words in lower case within ``CONTEXT``
    characters, ``lead_in`` the signs between the word before and the value.
    NULL and empty texts have none.  The work is linear in the text.
    """
    text = F.col(text_col)
    rows = docs.filter(text.rlike("[0-9]") | text.rlike(ASSIGNED)).select(
        F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.concat(text, F.lit(END)).alias("t"))
    every = lambda group: F.regexp_extract_all("t", F.lit(CANDIDATE), F.lit(group))
    parts = rows.select(F.monotonically_increasing_id().alias("row"), "id", "path", every(0).alias("whole"),
                        F.zip_with(every(1), every(2), lambda a, b: F.concat(a, b)).alias("values"))
    gap = lambda i: F.substring(F.get("whole", i), F.lit(1), F.char_length(F.get("whole", i)) - F.char_length(F.get("values", i)))
    near = F.transform("values", lambda v, i: F.struct(
        i.alias("pos"), v.alias("value"), F.char_length(F.get("whole", i)).cast("long").alias("span"),
        F.substring(gap(i), -CONTEXT, CONTEXT).alias("left"), F.substring(gap(i + 1), 1, CONTEXT).alias("right")))
    found = parts.filter(F.size("values") > 1).select("row", "id", "path", F.inline(F.slice(near, 1, F.size("values") - 1)))
    upto = Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return found.select(
        "row", "id", "path", (F.sum("span").over(upto) - F.char_length("value")).alias("start"), "value",
        F.lower(F.regexp_extract("left", r"(\p{L}+)[^\p{L}]*$", 1)).alias("before"),
        F.lower(F.regexp_extract("right", r"^[^\p{L}]*(\p{L}+)", 1)).alias("after"),
        F.regexp_extract("left", r"([^\p{L}\s]*)$", 1).alias("lead_in"))


def dictionary(docs: DataFrame, text_col: str = "text", least_share: float = 1e-5) -> DataFrame:
    """(``word``): words of ``LETTERS`` letters that make up at least ``least_share`` of all such words of all texts."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(rf"(?<![a-z0-9])[a-z]{{{LETTERS[0]},{LETTERS[1]}}}(?![a-z0-9])"),
                                                       F.lit(0))).alias("word"))
    counts = stage(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "secret-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.filter(F.col("n") >= total * least_share).select("word")


def with_features(found: DataFrame, words: DataFrame, labelled: DataFrame) -> DataFrame:
    """``found`` and the forest's inputs; ``labelled`` (``path``, ``before``, ``after``, ``y``) gives the rates of its words.

    Dictionary words of ``LETTERS`` letters count for the covered share.  A rate is the share of secrets among the labelled findings with that path
    or neighbouring word, drawn towards the overall share; unknown ones get it.
    """
    value, length = F.col("value"), F.char_length("value").cast("double")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / length
    found = found.withColumn("finding", F.concat_ws(":", "row", "start"))
    runs = found.select("finding", F.explode(F.regexp_extract_all(F.lower(value), F.lit(f"[a-z]{{{LETTERS[0]},{LETTERS[1]}}}"), F.lit(0))).alias("word"))
    cover = runs.join(words, "word").groupBy("finding").agg(F.sum(F.char_length("word")).alias("covered"))
    out = found.join(cover, "finding", "left").select(
        *found.columns, length.alias("length"), share(CHANGE).alias("changes"), share("[0-9]").alias("digits"),
        share("[A-Z]").alias("upper"), value.rlike("^[0-9a-f]+$").cast("double").alias("hex"),
        (F.size(F.array_distinct(F.split(value, ""))) / length).alias("distinct"),
        (F.coalesce("covered", F.lit(0)) / length).alias("dictionary"),
        F.coalesce(F.col("path").rlike("(?i)test|example|sample|mock|fixture").cast("double"), F.lit(0.0)).alias("mock_path"),
        F.col("lead_in").rlike("[=:]").cast("double").alias("assigned"))
    mean = labelled.agg(F.avg("y")).first()[0] or 0.0
    for c in ("path", "before", "after"):
        rate = (F.sum("y") + 2 * F.lit(mean)) / (F.count(F.lit(1)) + 2)
        rates = labelled.groupBy(F.col(c).alias("__w")).agg(rate.alias(f"{c}_rate"))
        out = out.join(rates, F.col(c).eqNullSafe(F.col("__w")), "left").drop("__w")
        out = out.withColumn(f"{c}_rate", F.coalesce(f"{c}_rate", F.lit(mean)))
    return out


def scan(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source",
         findings: DataFrame | None = None, train_rows: int = 20_000, trees: int = 30, depth: int = 6, seed: int = 42) -> DataFrame:
    """Every candidate of ``docs`` with its ``score`` (0 to 1) and ``is_secret`` (score at least 0.5).

    The forest learns from ``labels``, reviewed findings of these texts (id,
    ``start``, ``y`` 0 or 1), or from ``findings``, rows of ``candidates`` with ``y``
    from elsewhere; about ``train_rows`` of them at most, drawn by a hash.  Every
    candidate of every text is scored.  With labels of one kind only, or
    none, the score is their share.  Returns id, ``start``, ``value``, ``path``,
    ``before``, ``after``, ``score``, ``is_secret``; repeated rows are scanned one by
    one, an empty table gives an empty result.  The texts are read twice: for
    the candidates, which are staged, and for the dictionary.
    """
    found = stage(candidates(docs, id_col, text_col, path_col), "secret-candidates")
    if findings is None:
        known = labels.select(F.col(id_col).alias("id"), "start", F.col("y").cast("double").alias("y")).distinct()
        findings = found.join(known, ["id", "start"])
    findings = findings.withColumn("y", F.col("y").cast("double")).filter(F.col("y").isin(0.0, 1.0))
    findings = stage(findings, "secret-findings")
    n = findings.count()
    labelled = findings.filter(uniform(F.lit(seed), F.col("id"), F.col("start")) < train_rows / max(n, 1))
    kinds = {r[0] for r in labelled.select("y").distinct().collect()}
    result: list[Column] = [F.col("id").alias(id_col), "start", "value", "path", "before", "after"]
    if kinds != {0.0, 1.0}:
        share = float(bool(kinds) and max(kinds))
        return found.select(*result, F.lit(share).alias("score"), F.lit(int(share >= 0.5)).alias("is_secret"))
    words = stage(dictionary(docs, text_col), "secret-dictionary")
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="y")
    model = forest.fit(vector.transform(with_features(labelled, words, labelled)))
    scored = model.transform(vector.transform(with_features(found, words, labelled)))
    score = vector_to_array("probability")[1]
    return scored.select(*result, score.alias("score"), (score >= 0.5).cast("int").alias("is_secret"))


# Words that planted findings are put after, and look-alikes that are no secrets.
PLANT_AFTER = ("password = ", "token = \"", "secret: ", "api_key=", "passwd: '", "see ", "value ", "the ", "Key: ", "id=")
PLACEHOLDERS = ("your_password_here", "changeme12345", "example-token-0001", "xxxxxxxxxxxxxxxx1", "<redacted-by-policy>", "undefined",
                "process.env.TOKEN", "os.environ_value_1", "not-a-real-secret-1", "test_test_test_1234")


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", rows: int = 6000,
            seed: int = 42) -> DataFrame:
    """Labelled findings by construction: rows of ``candidates`` with ``y``, of values planted in copies of drawn texts.

    Into the first line feed or space after the middle of each drawn text goes
    one value: a secret (random access keys, hex and base-64 tokens, short
    passwords with signs) or a look-alike (card numbers, placeholders, joined
    words of the text, paths, digests).  Which words stand before it is drawn
    apart from what it is, so neighbours alone do not tell one from the other.
    About ``rows`` texts at most are drawn, by a hash of their ids.
    """
    n = docs.count()
    text = F.col(text_col)
    drawn = docs.filter(text.isNotNull() & (uniform(F.lit(seed), F.col(id_col)) < rows / max(n, 1)))
    draw = lambda salt, count: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col(id_col)), F.lit(count)).cast("int")
    raw = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary"), 256)
    b64 = F.translate(F.base64(F.unhex(raw)), "+/=", "xyz")
    digits = F.translate(raw, "abcdef", "274905")
    pick = lambda of, salt: F.element_at(F.array(*[F.lit(x) for x in of]), draw(salt, len(of)) + 1)
    words = F.slice(F.filter(F.split(F.substring(text, 1, 400), r"\s+"), lambda w: w.rlike("^[A-Za-z]{4,9}$")), 1, 3)
    kinds = [
        (1, F.concat(F.lit("AKIA"), F.translate(F.upper(F.substring(raw, 1, 16)), "0189", "KQXZ"))), (1, F.substring(raw, 1, 40)),
        (1, F.substring(b64, 1, 24)), (1, F.concat(F.substring(b64, 1, 4), F.lit("!"), F.substring(b64, 9, 3), F.lit("$"), F.substring(b64, 20, 2))),
        (1, F.substring(b64, 5, 10)),
        (0, F.substring(digits, 1, 16)), (0, pick(PLACEHOLDERS, "placeholder")), (0, F.concat(F.array_join(words, "_"), F.lit("_1"))),
        (0, F.concat(F.lit("usr/lib/"), F.array_join(words, "/"), F.lit("/v2"))), (0, F.concat(F.substring(digits, 1, 8), F.lit("-"), F.substring(digits, 9, 6))),
    ]
    kind = draw("kind", len(kinds))
    value, y = F.lit(None).cast("string"), F.lit(None).cast("int")
    for k, (label, v) in enumerate(kinds):
        value, y = F.when(kind == k, v).otherwise(value), F.when(kind == k, F.lit(label)).otherwise(y)
    # The text around the place, so that neighbours are those of real texts; the window holds the planted value and its context.
    half = F.floor(F.char_length(text) / 2).cast("int")
    left = F.regexp_replace(F.substring(text, F.greatest(half - 2 * CONTEXT, F.lit(1)), F.lit(2 * CONTEXT)), r"\S*$", "")
    right = F.regexp_replace(F.substring(text, half + 1, F.lit(2 * CONTEXT)), r"^\S*", "")
    marked = drawn.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), y.alias("y"), value.alias("planted"),
                          F.concat(left, pick(PLANT_AFTER, "after")).alias("lead"), right.alias("rest"))
    marked = marked.filter(F.char_length("planted") >= 6).withColumn("t", F.concat("lead", "planted", F.lit(" "), "rest"))
    marked = stage(marked, "secret-planted")
    found = candidates(marked.select("id", "t", "path"), "id", "t", "path")
    at = marked.select(F.col("id").alias("__id"), F.char_length("lead").cast("long").alias("__at"), "y").dropDuplicates(["__id"])
    return found.join(at, (F.col("id") == F.col("__id")) & (F.col("start") == F.col("__at"))).drop("__id", "__at")
