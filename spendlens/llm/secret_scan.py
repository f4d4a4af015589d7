"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are what is assigned to a name that is or ends in one like password
or token, the passwords of URLs, long runs of letters and digits, and the known
formats of keys. A random forest decides which of them are secrets from
the candidate's length and character transitions, its coverage by a dictionary
of ordinary words, the path it stands in, and its neighbouring words. The
forest is fitted on labelled findings: given by the caller (value, before,
after, secret), or the candidates whose label is beyond doubt by the rules
below. At most ``LABELLED`` of them are taken (those of smallest hash), which
bounds the model; candidates, features and decisions cover every text whole.

Only DataFrame functions and Spark's own DataFrame-based forest run here.

Defined results: null and empty texts have no candidates; rows that share
identifier and text are one; null identifiers are kept; if the labelled
findings hold one class or none, there is nothing to learn and every candidate
has their share of secrets (1 without any) as its probability; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import session, stored

#: Labelled findings at most, trees, their depth, probability from which a candidate is a secret.
LABELLED, TREES, TREE_DEPTH, CERTAIN = 20_000, 20, 6, 0.5
#: Code points of text looked at on either side of a candidate.
NEAR = 48

# --- fixed values: names that secrets are assigned to, formats that are secrets, words that are not ---
NAMES = ("password passwd passphrase pwd secret token apikey api_key api-key access_key access-key auth_key "
         "private_key client_secret credential bearer").split()
FORMATS = [r"A(?:KIA|SIA)[0-9A-Z]{16}", r"gh[pousr]_[A-Za-z0-9]{36,}", r"xox[abprs]-[A-Za-z0-9-]{10,}",
           r"sk_(?:live|test)_[A-Za-z0-9]{16,}", r"AIza[0-9A-Za-z_-]{35}", r"glpat-[A-Za-z0-9_-]{20,}"]
WORDS = ("example sample test dummy demo fake placeholder changeme change default your insert here none null true "
         "false admin user guest foobar foo bar lorem ipsum qwerty letmein hunter welcome version build release index "
         "image static assets public http https www html json".split())
NUMBER_WORDS = "phone tel fax card order invoice isbn issn account id ref no nr number page ticket doi date".split()

NAME = "(?i:" + "|".join(NAMES) + ")"
ASSIGNED = NAME + r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?"
RUN = r"[A-Za-z0-9_+/-]"
VALUE = r"[^\s\"',;]{6,}"
#: What stands between a URL's scheme and the password of its user.
USER = r"://[^\s/:@\"'<>\[\]]*+:"
# a name may be the end of a longer one (DB_PASSWORD, userPassword): the whole run before it belongs to it
CANDIDATE = (rf"{USER}[^\s/\"'<>]+(?=@)|(?<!{RUN})(?:{RUN}*?{ASSIGNED}{VALUE}|"
             rf"(?=[A-Za-z_+/-]*+\d){RUN}{{12,}}+={{0,2}}|{'|'.join(FORMATS)})")
#: What stands before the value in a candidate.
LEAD = rf"^(?:{USER}|{RUN}*?{ASSIGNED}(?={VALUE}))"

FEATURES = ["length", "digits", "upper", "lower", "other", "transitions", "alternation", "repeats", "distinct",
            "dictionary", "hex", "format", "assigned", "quoted", "path", "number_word", "word_before", "word_after"]
FOUND = ["doc_id", "th", "pos", "start", "end", "value", "before", "after"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (the text's hash), pos, start and end (code points), value,
    and the text before and after it."""
    p = F.lit(CANDIDATE)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")) \
        .where(F.col("text").rlike(CANDIDATE)) \
        .select("doc_id", F.xxhash64("text").alias("th"), F.regexp_extract_all("text", p, F.lit(0)).alias("hits"),
                F.split("text", CANDIDATE, -1).alias("rest")) \
        .dropDuplicates(["doc_id", "th"])
    each = rows.select("doc_id", "th", F.posexplode(F.arrays_zip(
        "hits", F.slice("rest", 1, F.size("hits")).alias("left"), F.slice("rest", 2, F.size("hits")).alias("right"))))
    so_far = Window.partitionBy("doc_id", "th").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    hit, left = F.col("col.hits"), F.col("col.left")
    end = F.sum(F.length(hit) + F.length(left)).over(so_far)
    value = F.regexp_replace(hit, LEAD, "")
    placed = each.select("doc_id", "th", "pos", end.cast("long").alias("end"), value.alias("value"),
                         F.concat(F.right(left, F.lit(NEAR)),
                                  F.left(hit, F.length(hit) - F.length(value))).alias("before"),
                         F.left(F.col("col.right"), F.lit(NEAR)).alias("after"))
    return placed.select("doc_id", "th", "pos", (F.col("end") - F.length("value")).alias("start"), "end", "value",
                         "before", "after")


def _share(pattern: str) -> Column:
    return F.regexp_count("value", F.lit(pattern)) / F.greatest(F.length("value"), F.lit(1))


def with_features(found: DataFrame) -> DataFrame:
    """``found`` (value, before, after) with the columns of FEATURES, all doubles."""
    n = F.greatest(F.length("value"), F.lit(1))
    left_words = F.regexp_replace(F.lower("value"), "|".join(sorted(WORDS, key=len, reverse=True)), "")
    in_url = F.col("before").rlike(USER + "$") & F.col("after").startswith("@")
    last_word = F.lower(F.regexp_extract("before", r"(\w+)\W*$", 1))
    columns = {
        "length": F.length("value"),
        "digits": _share("[0-9]"), "upper": _share("[A-Z]"), "lower": _share("[a-z]"), "other": _share("[^A-Za-z0-9]"),
        # from one kind of character to another
        "transitions": _share(r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|"
                              r"(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"),
        # as words go: a vowel after a consonant
        "alternation": _share(r"(?i)(?<=[bcdfghjklmnpqrstvwxz])(?=[aeiouy])"),
        "repeats": _share(r"(.)(?=\1)"),
        "distinct": F.size(F.array_distinct(F.split("value", ""))) / n,
        "dictionary": (F.length("value") - F.length(left_words)) / n,
        "hex": F.col("value").rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "format": F.col("value").rlike("^(?:" + "|".join(FORMATS) + ")"),
        "assigned": F.col("before").rlike(ASSIGNED + "$") | in_url,
        "quoted": F.col("before").rlike("[\"']$"),
        "path": ~in_url & (F.col("before").rlike(r"(?:://|/|\\|www\.|@)\S*$")
                           | F.col("value").rlike(r"/.*/|\.[a-z]{2,4}$") | F.col("after").rlike(r"^\.[a-z]{2,4}\b")),
        "number_word": last_word.isin(NUMBER_WORDS),
        "word_before": F.length(last_word),
        "word_after": F.length(F.regexp_extract("after", r"^\W*(\w+)", 1)),
    }
    return found.withColumns({k: F.coalesce(columns[k].cast("double"), F.lit(0.0)) for k in FEATURES})


def certain_label() -> Column:
    """True or false for findings beyond doubt, else null (``found`` with features)."""
    plain = F.col("dictionary") >= 0.5
    secret = (F.col("format") == 1) | ((F.col("assigned") == 1) & (F.col("length") >= 12) & (F.col("digits") > 0)
                                       & (F.col("digits") < 1))
    number = F.col("value").rlike(r"^[0-9_+/-]+=*$")
    free = (F.col("assigned") == 0) & (F.col("format") == 0)
    path = free & ((F.col("path") == 1) | ((F.col("alternation") > 0.2) & (F.col("digits") < 0.3)))
    return F.when(plain | (free & number) | path, F.lit(False)).when(secret, F.lit(True))


def labelled_findings(found: DataFrame, limit: int = LABELLED) -> DataFrame:
    """At most ``limit`` findings (those of smallest hash) with ``secret``, by the rules above."""
    label = with_features(found).withColumn("secret", certain_label()).where("secret IS NOT NULL")
    return label.select("value", "before", "after", "secret") \
        .orderBy(F.xxhash64("value", "before", "after"), "value", "before", "after").limit(limit)


def _probability(found: DataFrame, labelled: DataFrame) -> DataFrame:
    """``found`` with ``probability`` by a forest fitted on ``labelled``."""
    # bounded by LABELLED rows: one partition is enough, and makes the fit the same on any cluster
    train = stored(with_features(labelled).select(*FEATURES, F.col("secret").cast("double").alias("label"))
                   .coalesce(1), "labelled")
    n, ones = train.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if n == 0 or ones in (0, n):
        return found.withColumn("probability", F.lit(float(ones / n) if n else 1.0))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=TREE_DEPTH, seed=6, featuresCol="features",
                                    labelCol="label", probabilityCol="chance").fit(vectors.transform(train))
    scored = forest.transform(vectors.transform(with_features(found)))
    return scored.select(*found.columns, vector_to_array("chance")[1].alias("probability"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every candidate of every text with probability and is_secret."""
    session(docs)
    found = stored(candidates(docs, id_col, text_col), "candidates")
    scored = _probability(found, labelled if labelled is not None else labelled_findings(found))
    return scored.withColumn("is_secret", F.col("probability") >= CERTAIN)


def redacted(docs: DataFrame, labelled: DataFrame | None = None, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask`` (n_chars follows, where it exists)."""
    spans = scan(docs, labelled).where("is_secret").groupBy("doc_id", "th").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    spans = stored(spans, "secrets").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "spans")
    rows = docs.select(F.struct("*").alias("row"))
    text = F.col("row.text")
    suspect = F.coalesce(text.rlike(CANDIDATE), F.lit(False))
    hit = rows.where(suspect).withColumn("text", text).withColumn("th", F.xxhash64(text))
    joined = hit.join(spans, hit["row.doc_id"].eqNullSafe(spans["_id"]) & (hit["th"] == spans["_th"]), "left")

    def cut(acc: Column, s: Column) -> Column:
        part = F.substring(F.col("text"), acc["at"].cast("int"), (s["start"] + 1 - acc["at"]).cast("int"))
        return F.struct(F.concat(acc["out"], part, F.lit(mask)).alias("out"), (s["end"] + 1).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(1).cast("long").alias("at"))
    done = F.aggregate("spans", start, cut, lambda a: F.concat(
        a["out"], F.substring(F.col("text"), a["at"].cast("int"), F.length("text"))))
    changed = joined.withColumn("text", F.when(F.col("spans").isNotNull(), done).otherwise(F.col("text")))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        row = F.when(F.col("spans").isNotNull(), row.withField("n_chars", F.length("text").cast(kind))).otherwise(row)
    return rows.where(~suspect).select("row.*").unionByName(changed.select(row.alias("row")).select("row.*"))
