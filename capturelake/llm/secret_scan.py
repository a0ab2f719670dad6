"""Secret scans: candidate strings judged by a random forest, in DataFrame and ML operations only.

Null and empty texts hold no candidate. Rows that share an id (a null id too)
are redacted together; repeated rows give repeated findings; an empty table
gives an empty result, as the built-in examples still train the forest. Only
the named columns are read, other columns pass unchanged.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable

#: Most labelled findings of the corpus that the forest is fitted on (the first by hash), beside the built-in examples.
MOST_LABELLED = 20_000
EXAMPLES = 3_800
TREES, TREE_DEPTH, SEED = 30, 7, 42
#: A finding is a secret from this share of the forest on.
LEAST_SCORE = 0.5
#: Ids with secrets that may be broadcast with their secrets, and the bytes of these.
BROADCAST_IDS, BROADCAST_BYTES = 100_000, 20_000_000
MARK = "[SECRET]"

# Shapes and words that speak for or against a secret.
CANDIDATE = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
KEY_WORDS = r"(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth(orization)?|bearer|credential|private[_-]?key)"
ISSUED = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abpr]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})$"
HASH_WORDS = r"(commit|revision|checksum|digest|integrity|sha-?\d+|md5|uuid|guid|etag|version|build|order|number|isbn)"
PLACEHOLDER = r"(example|sample|dummy|placeholder|changeme|your[_-]|xxxx|0{8}|12345678|^1234|test[_-]|todo|\*\*\*|^[$<{%])"
#: What stands after a key word, an assignment and maybe a quote; the value is the fourth group (quoted) or the fifth.
ASSIGNED = r"(?i)" + KEY_WORDS + r"[\"']?[=:]+(?:[\"']([^\"']{8,})|([^\"'\s,;&]{8,}))"
#: The same where the key word stands in an earlier word.
VALUE = r"^[\"'`]?([^\"'`\s]{8,}?)[\"'`]?[,;.)]*$"
USERINFO = r"://[^/@\s:]*:([^/@\s]{8,})@"
#: Signs of which a value has one at least.
STRONG = r"[0-9!@#$%^&*?~+]"
DICTIONARY = (
    "about access account action address admin after application archive article asset author backup before block board body "
    "branch build button cache camel card case center change check class client close cloud code color column comment commit "
    "common config connect content control count create data date default delete design detail dialog document domain download "
    "element email engine error event example export field file filter final first folder font footer form frame from function "
    "global graph group handler header heading height history home html icon image import index input install item java join "
    "kernel label language large layout left level library license light line link list load local login main manager map mask "
    "master match media menu merge message method middle mobile model module name native network node note number object online "
    "option order output package page panel parent parse part password path pattern people photo place plugin point policy post "
    "print product profile project public query random read record remote render report request reset response result right root "
    "route rule sample script search second secret section select server service session setting share show side single size small "
    "source space span start state static status step stop store stream string style submit support switch system table target "
    "task template test text theme this time title token tool total tree type under unit update upload user utility value version "
    "video view visible volume wait warning web width widget window word work world write year your"
).split()


def find_candidates(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (doc, at, word, candidate, before, after); at counts words.

    Candidates are long strings in words with a digit, an assignment or the
    prefix of an issued key, values of eight signs and more that are assigned
    to a key word (beside it or in the next words), and passwords in addresses.
    Texts are split once and their places filtered in the array, so only
    candidates become rows.
    """
    words = df.select(F.col(f"`{key}`").alias("doc"), F.split(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), r"\s+").alias("words"))

    def word(i: Column, back: int = 0) -> Column:
        return F.when(i >= back, F.get("words", i - back)).otherwise("") if back else F.get("words", i)

    def named(i: Column) -> Column:
        """Whether a key word and an assignment end right before word i."""
        return word(i, 1).rlike(r"[=:][\"'`]?$") & F.concat_ws(" ", word(i, 2), word(i, 1)).rlike("(?i)" + KEY_WORDS + r"[\"'`]?\s?[=:]+[\"'`]?$")

    def wanted(i: Column) -> Column:
        w = F.get("words", i)
        long = (F.char_length(w) >= 16) & w.rlike(CANDIDATE) & w.rlike(r"\d|[=:]|AKIA|gh[pousr]_|xox[abpr]-")
        return long | ((F.char_length(w) >= 8) & w.rlike(STRONG) & (named(i) | w.rlike(ASSIGNED)))

    places = words.withColumn("places", F.filter(F.sequence(F.lit(0), F.size("words") - 1), wanted))
    # posexplode_outer: see the note in decontamination.py on the filter added for the plain form.
    found = places.select("doc", "words", F.posexplode_outer("places").alias("_n", "at")).filter(F.col("at").isNotNull()).select(
        "doc", "at", F.get("words", F.col("at")).alias("word"), named(F.col("at")).alias("named"),
        F.array_join(F.array_compact(F.array(*[F.when(F.col("at") >= k, F.get("words", F.col("at") - k)) for k in (3, 2, 1)])), " ").alias("left"),
        F.array_join(F.array_compact(F.array(*[F.get("words", F.col("at") + k) for k in (1, 2)])), " ").alias("after"))
    values = F.array(
        F.regexp_extract("word", ASSIGNED, 4), F.regexp_extract("word", ASSIGNED, 5), F.regexp_extract("word", USERINFO, 1),
        F.when(F.col("named"), F.regexp_extract("word", VALUE, 1)).otherwise(""))
    strong = F.filter(values, lambda v: v.rlike(STRONG) & ~v.contains("://"))
    parts = found.withColumn("candidates", F.array_distinct(F.concat(F.regexp_extract_all("word", F.lit(f"({CANDIDATE})")), strong)))
    return parts.select("doc", "at", "word", "left", "after", F.explode("candidates").alias("candidate")).select(
        "doc", "at", "word", "candidate",
        F.concat_ws(" ", "left", F.expr("substring_index(word, candidate, 1)")).alias("before"), "after")


def _share(pattern: str) -> Column:
    """Share of the candidate's characters that match."""
    return F.lit(1.0) - F.char_length(F.regexp_replace("candidate", pattern, "")) / F.char_length("candidate")


def _features() -> dict[str, Column]:
    c, before, around = F.col("candidate"), F.lower("before"), F.lower(F.concat_ws(" ", "before", "after"))
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]+", "a"), "[A-Z]+", "B"), "[0-9]+", "0")
    rest = F.expr("substring(word, instr(word, candidate) + char_length(candidate))")
    # The piece of the word that holds the candidate: a path elsewhere in it says nothing.
    piece = F.concat(F.regexp_extract("before", r"([^\s\"'=,;&?<>(){}\[\]]*)$", 1), c, F.regexp_extract(rest, r"^([^\s\"'=,;&<>(){}\[\]]*)", 1))
    login = F.col("before").rlike(r"://[^/@\s:]*:$") & rest.startswith("@")
    known = F.char_length(F.regexp_replace(F.lower(c), "(" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")", ""))
    return {
        "length": F.char_length(c),
        "transitions": (F.char_length(runs) - 1) / F.char_length(c),
        "dictionary": F.lit(1.0) - known / F.char_length(c),
        "digits": _share("[0-9]"),
        "upper": _share("[A-Z]"),
        "hexadecimal": c.rlike("^[0-9a-f]+$|^[0-9A-F]+$"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.char_length(c),
        "issued": c.rlike(ISSUED),
        "path_steps": F.regexp_count(piece, F.lit("[/\\\\]")),
        "path_like": piece.rlike(r"://|^\.?/|\.[a-z]{2,4}([?#]|$)") & ~login,
        "key_before": before.rlike(KEY_WORDS + r"\W*$") | login,
        "key_near": around.rlike(KEY_WORDS),
        "assigned": before.rlike(r"[=:]\s*[\"']?$"),
        "quoted": F.col("before").rlike(r"[\"'`]$"),
        "hash_before": before.rlike(r"\b" + HASH_WORDS + r"\W*$"),
        "placeholder": F.lower(c).rlike(PLACEHOLDER),
        "dashes": F.regexp_count(c, F.lit("[-_]")),
    }


def with_features(found: DataFrame) -> DataFrame:
    """Add the numeric features of each candidate."""
    return found.withColumns({f"f_{n}": f.cast("double") for n, f in _features().items()})


def _weak_label() -> Column:
    """1 or 0 where the finding's form and neighbours leave no doubt, else null."""
    f = F.col
    against = (f("f_placeholder") > 0) | (f("f_path_like") > 0) | (f("f_hash_before") > 0)
    return F.when(f("f_issued") > 0, 1.0).when(against, 0.0).when((f("f_key_before") > 0) & (f("f_assigned") > 0) & (f("f_digits") > 0), 1.0)


def example_texts(spark: SparkSession, rows: int = EXAMPLES) -> DataFrame:
    """Labelled lines (doc, text, label): invented secrets and things that only look alike."""
    h = F.sha2(F.col("id").cast("string"), 256)
    mixed = F.translate(h, "048bdf", "KqZxWm")
    lines = (
        (1, F.concat(F.lit("the key is AKIA"), F.upper(F.translate(F.substring(h, 1, 16), "0189", "QRST")), F.lit(" as set"))),
        (1, F.concat(F.lit('set token = "'), F.substring(h, 1, 40), F.lit('" here'))),
        (1, F.concat(F.lit("with password="), F.substring(h, 1, 18), F.lit(" now"))),
        (1, F.concat(F.lit("api_key: "), F.substring(mixed, 1, 32), F.lit(" for it"))),
        (1, F.concat(F.lit("Authorization: Bearer "), F.substring(mixed, 1, 44), F.lit(" sent"))),
        (1, F.concat(F.lit("use ghp_"), F.substring(mixed, 1, 36), F.lit(" to push"))),
        (1, F.concat(F.lit("client_secret='"), F.substring(mixed, 3, 28), F.lit("' in it"))),
        (1, F.concat(F.lit('a password = "'), F.substring(mixed, 1, 5), F.lit("&"), F.substring(mixed, 9, 3), F.lit('!" there'))),
        (1, F.concat(F.lit("dial postgres://app:"), F.substring(mixed, 1, 20), F.lit("@db.internal/main now"))),
        (1, F.concat(F.lit("get https://api.site.org/v1?api_key="), F.substring(mixed, 1, 30), F.lit(" then"))),
        (1, F.concat(F.lit('{"url":"https://cdn.site.org/a.js","token":"'), F.substring(mixed, 1, 30), F.lit('"} sent'))),
        (0, F.concat(F.lit('a password = "changeme'), F.substring(h, 1, 3), F.lit('!" there'))),
        (0, F.concat(F.lit("in commit "), F.substring(h, 1, 40), F.lit(" merged"))),
        (0, F.concat(F.lit("see https://cdn.example.org/static/"), F.substring(h, 1, 20), F.lit("/main.js there"))),
        (0, F.concat(F.lit("item "), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 13, 3), F.lit("-a"),
                     F.substring(h, 17, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(" found"))),
        (0, F.concat(F.lit("sha256 checksum "), h, F.lit(" listed"))),
        (0, F.concat(F.lit('token = "your_token_example_'), F.substring(h, 1, 3), F.lit('" to fill'))),
        (0, F.concat(F.lit("under /usr/share/doc/package-"), F.substring(h, 1, 4), F.lit("-2024/readme.txt read"))),
        (0, F.concat(F.lit("call renderTemplateHeader"), F.substring(h, 1, 2), F.lit("Element(value) with id=section_heading_title_"), F.substring(h, 3, 2))),
    )
    kind = F.col("id") % len(lines)
    return spark.range(rows).select(
        F.col("id").alias("doc"),
        F.coalesce(*[F.when(kind == n, t) for n, (_, t) in enumerate(lines)]).alias("text"),
        F.coalesce(*[F.when(kind == n, F.lit(float(label))) for n, (label, _) in enumerate(lines)]).alias("label"))


def train(findings: DataFrame, most: int = MOST_LABELLED) -> RandomForestClassificationModel:
    """Fit the forest on findings with features and a label: at most ``most`` of them, beside the built-in examples."""
    spark = findings.sparkSession
    names = [f"f_{n}" for n in _features()]
    examples = example_texts(spark)
    told = with_features(find_candidates(examples, "doc", "text")).join(examples.select("doc", "label"), "doc")
    place = F.xxhash64("candidate", "before")
    sample = findings.filter(F.col("label").isNotNull()).withColumn("_place", place).orderBy("_place", *names).limit(most)
    # A bounded sample in one sorted partition makes the fit repeatable.
    rows = durable(sample.select("label", *names).union(told.select("label", *names)).repartition(1).sortWithinPartitions("label", *names))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=TREE_DEPTH, seed=SEED, featuresCol="features", labelCol="label")
    return forest.fit(VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("features", "label"))


def scan_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", findings: DataFrame | None = None,
                 least_score: float = LEAST_SCORE) -> DataFrame:
    """One row per candidate: doc, at, candidate, before, after, the forest's score and whether it is a secret.

    ``findings`` are labelled findings (doc, at, word, candidate, before, after,
    label); without them, candidates of the corpus whose form and neighbours
    leave no doubt are the labelled ones.
    """
    found = durable(with_features(find_candidates(df, key, text)))
    labelled = with_features(findings) if findings is not None else found.withColumn("label", _weak_label())
    model = train(labelled)
    names = [f"f_{n}" for n in _features()]
    scored = model.transform(VectorAssembler(inputCols=names, outputCol="features").transform(found))
    score = F.round(vector_to_array("probability")[1], 6)
    return scored.select("doc", "at", "candidate", "before", "after", score.alias("score"), (score >= least_score).alias("secret"))


def redact(df: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars", **options) -> DataFrame:
    """The documents, same columns, with each secret replaced by a mark and ``length`` brought up to date."""
    secrets = durable(scan_secrets(df, key, text, **options).filter("secret").groupBy(F.col("doc").alias("__llm_id")).agg(
        F.array_sort(F.collect_set("candidate"), lambda a, b: F.char_length(b) - F.char_length(a)).alias("__llm_secrets")))
    n, size = secrets.agg(F.count(F.lit(1)), F.sum(F.aggregate("__llm_secrets", F.lit(0), lambda s, x: s + F.octet_length(x)))).first()
    side = F.broadcast(secrets) if n <= BROADCAST_IDS and (size or 0) <= BROADCAST_BYTES else secrets
    joined = df.join(side, df[key].eqNullSafe(side["__llm_id"]), "left")
    hit = F.col("__llm_secrets").isNotNull()
    clean = F.aggregate("__llm_secrets", F.col(f"`{text}`").cast("string"), lambda t, s: F.replace(t, s, F.lit(MARK)))
    new = {text: F.when(hit, clean).otherwise(F.col(f"`{text}`"))}
    if length in df.columns:
        new[length] = F.when(hit, F.char_length(clean)).otherwise(F.col(f"`{length}`")).cast(df.schema[length].dataType)
    return joined.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])
