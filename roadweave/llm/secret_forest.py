"""Secret scans: candidates by shape, and a random forest that removes false findings by length, character transitions, dictionary
coverage, path and neighbouring words. DataFrame functions only: the forest becomes one column expression, so a document is
scanned, and redacted, where it is read."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Words around secrets, around harmless tokens, in placeholders; common words and letter pairs of prose.
SECRET_WORDS = "passw|passwd|pwd|secret|token|api[_-]?key|apikey|auth|credential|private|access|bearer|signing"
HARMLESS_WORDS = "commit|sha1|sha256|sha512|md5|hash|digest|checksum|etag|uuid|guid|version|build|revision|href|isbn|order|invoice|phone|serial|session_id|trace"
PLACEHOLDERS = "example|sample|dummy|changeme|placeholder|your|test|xxxx|todo|redacted|123456|abcdef"
COMMON_WORDS = "the|and|that|with|this|from|have|not|are|was|you|for|key|name|user|data|file|path|page|time|type|value|index|config|server|client|table|field|model|image|style|script|http|www|com|html|json|data|text|line|size|main|home|list|item|order|group|event|road|street|profile|setting|service|report|project|example|password|secret|token|your|api|change|test"
PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce|ch|ge|un|ie|el|la|qu|ci"
PREFIXES = "^(AKIA|ASIA|ghp_|gho_|glpat-|xox[abp]-|sk_live_|sk-|AIza|eyJ)"
TEST_PATHS = "test|example|fixture|sample|docs?/|mock"
#: A token: a known prefix and 8 characters or more, or 12 or more of a token's alphabet up to a prefix; = only at the end. Each repetition
#: is possessive or bounded and starts where such a run starts, so that a long run is read once.
_STARTS = f"(?:{PREFIXES[2:-1]})"
_PREFIXED = rf"{_STARTS}[A-Za-z0-9+/_.-]{{8,}}+={{0,2}}"
_RUN = rf"(?:(?!(?<![A-Za-z0-9]){_STARTS}[A-Za-z0-9+/_.-]{{8}})[A-Za-z0-9+/_.-]){{12,}}+={{0,2}}"
#: Characters that mark candidates in a text, and those that stand for them where a text holds them itself; no value holds one.
_ESCAPE, _OPEN, _SHUT = "\ufdd0", "\ufdd1", "\ufdd2"
_ESCAPED = {_ESCAPE: "\ufdd3", _OPEN: "\ufdd4", _SHUT: "\ufdd5"}
_NOT = "\ufdd0-\ufdd5"
#: A name with a secret's word in it, and what stands between a name and its value.
_NAME = rf"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z0-9+/_.-]{{0,100}}?(?i:{SECRET_WORDS}))[A-Za-z0-9+/_.-]{{1,160}}+[\"']?"
_BETWEEN = r"(?:\s{0,4}+(?:=>|:=|[=:]{1,3})|\s{1,4}+(?:is|ist)(?=\s))"
#: A candidate: the password of a URL; a value behind a secret's name, in quotes of either kind, behind white space, or bare; a lone token.
CANDIDATE = (
    rf"""(://[^\s/:@"'{_NOT}]{{0,64}}+:)([^\s/@"'{_NOT}]{{4,1024}}+)(?=@)"""
    rf"""|({_NAME}{_BETWEEN})(?:(\s{{0,4}}+")([^"\s{_NOT}]{{6,1024}}+)(?=")|(\s{{0,4}}+')([^'\s{_NOT}]{{6,1024}}+)(?=')|(\s{{1,4}}+["']?)([^\s"'<>{_NOT}]{{6,}}+)|(["']?)([^\s"'<>,;&(){{}}\[\]\\{_NOT}]{{6,}}+))"""
    rf"""|((?<![A-Za-z0-9]){_PREFIXED}|(?<![A-Za-z0-9+/_.-]){_RUN})"""
)
_MARKED = f"$1$3$4$6$8$10{_OPEN}$2$5$7$9$11$12{_SHUT}"
#: The name at the end of what stands before a value; a URL there; marks at a value's end that aren't part of it; the ends of pieces of a text.
_KEY = r"""([A-Za-z_][A-Za-z0-9_.-]{0,60})["']?(?:\s{0,4}(?:=>|:=|[=:]{1,3})|\s{1,4}(?:is|ist)(?=\s))\s{0,4}["']?$"""
_URL = r"""://[^\s/:@"']{0,64}:$"""
_TAIL = "(?<![.:,;)])[.:,;)]++$"
_PIECES = r"""(?<=[\s"'<>,;&(){}\[\]\\=:])|(?=[\s"'<>,;&(){}\[\]\\=:])"""
#: Parts that the secrets of a text are dealt to, so that a piece is looked for among few.
PARTS = 256

FEATURES = ("length", "digits", "uppers", "lowers", "marks", "transitions", "distinct", "covered", "pairs", "hex", "only_digits", "prefix", "placeholder", "key_secret", "key_harmless", "near_secret", "near_harmless", "slashes", "dotted", "test_path")


def lower(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def features(value: Column, key: Column, left: Column, right: Column, path: Column) -> list[Column]:
    """One double for each of FEATURES. value is the candidate, key the name it is given, left and right the words beside it."""
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    low = F.lower(value)
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9]", "."), "[A-Z]", "U"), "[a-z]", "L"), "[0-9]", "D")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    flag = lambda c: c.cast("double")
    return [
        n, share("[0-9]"), share("[A-Z]"), share("[a-z]"), share("[^A-Za-z0-9]"),
        F.regexp_count(kinds, F.lit("(?<=U)[^U]|(?<=L)[^L]|(?<=D)[^D]|(?<=[.])[^.]")) / n,
        F.size(F.array_distinct(F.split(value, ""))) / n,
        (n - F.length(F.regexp_replace(low, COMMON_WORDS, ""))) / n,
        F.regexp_count(low, F.lit(f"(?=({PAIRS}))")) / n,
        flag(low.rlike("^[0-9a-f]+$")), flag(value.rlike("^[0-9.-]+$")), flag(value.rlike(PREFIXES)), flag(low.rlike(PLACEHOLDERS)),
        flag(lower(key).rlike(SECRET_WORDS)), flag(lower(key).rlike(HARMLESS_WORDS)), flag(lower(left).rlike(SECRET_WORDS)), flag(F.concat_ws(" ", lower(left), lower(right)).rlike(HARMLESS_WORDS)),
        F.regexp_count(value, F.lit("/")).cast("double"), flag(value.rlike("(?<![A-Za-z])[A-Za-z]{2,}+[.][A-Za-z]{2,5}$")), flag(lower(path).rlike(TEST_PATHS)),
    ]


def labelled_findings(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """Reviewed findings to learn from when no others are given: value, key, left, right, path, secret. Shapes of tokens with their keys, and
    of what resembles them: digests of commits and files, ids, paths, placeholders, long names, numbers."""
    ids = spark.range(rows).withColumn("h", F.sha2(F.concat(F.lit("finding"), F.col("id").cast("string")), 512))
    ids = ids.withColumns({"big": F.translate(F.upper("h"), "01", "XQ"), "mixed": F.translate(F.base64(F.unhex("h")), "+/=", "xYz"), "digits": F.translate("h", "abcdef", "123456")})
    ids = ids.withColumn("letters", F.translate("mixed", "0123456789", "qWzRkTvLxJ"))
    h, big, mixed, digits, letters = (F.col(c) for c in ("h", "big", "mixed", "digits", "letters"))
    word = lambda k: F.element_at(F.array(*map(F.lit, ["user", "profile", "street", "event", "report", "service", "config", "road", "image", "group", "setting", "table"])), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(12)) + 1).cast("int"))
    near = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.pmod(F.xxhash64("id", F.lit(99)), F.lit(len(x))) + 1).cast("int"))
    none = F.lit(None).cast("string")
    prose = lambda k: F.element_at(F.array(*map(F.lit, ["understanding", "communication", "international", "neighbourhood", "particularly", "Verantwortung", "Geschwindigkeit", "Zusammenarbeit", "selbstverständlich", "responsabilidad", "desarrolladores", "conocimiento", "aujourd'hui", "gouvernement", "particulièrement", "environnement", "required", "invalid", "missing", "everything", "something", "expired", "nothing", "unknown"])), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(24)) + 1).cast("int"))
    syllable = lambda k: F.element_at(F.array(*map(F.lit, ["th", "er", "on", "an", "re", "in", "tion", "che", "lich", "ung", "de", "la", "ou", "que", "es", "ent", "ar", "os", "ich", "schen", "wh", "ly", "st", "eau"])), (F.pmod(F.xxhash64("id", F.lit(200 + k)), F.lit(24)) + 1).cast("int"))
    secret_key = near("password", "passwd", "db_password", "secret", "api_key", "token", "PWD")
    cut = lambda c, a, b: F.substring(c, 1, F.lit(a) + F.pmod(F.xxhash64("id", F.lit(7)), F.lit(b - a + 1)).cast("int"))
    kinds = [
        (F.concat(F.lit("AKIA"), F.substring(big, 1, 16)), none, near("of", "the", "key", "and"), True),
        (cut(h, 16, 24), near("password", "passwd", "secret", "db_password"), near("the", "und", "de"), True),
        (cut(h, 32, 48), none, near("token =", "secret =", "api_key:", "access token"), True),
        (cut(mixed, 20, 44), near("token", "api_key", "auth_token", "SECRET_KEY"), near("export", "set", "the"), True),
        (F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)), none, near("with", "token", "the"), True),
        (cut(mixed, 24, 40), none, near("password:", "bearer", "credential ="), True),
        (F.substring(h, 1, 40), near("commit", "sha1", "revision"), near("at", "see", "of"), False),
        (F.substring(h, 1, 40), none, near("commit", "checksum", "digest", "md5"), False),
        (F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), near("id", "uuid", "ref"), near("the", "order", "of"), False),
        (F.concat_ws("_", word(1), word(2), word(3), F.substring(digits, 1, 4)), none, near("the", "see", "in"), False),
        (F.concat_ws("_", F.lit("your"), word(1), near("api_key", "token", "secret", "password"), F.lit("here123")), near("token", "password", "api_key"), near("set", "the"), False),
        (F.concat(F.lit("changeme"), F.lit("123456"), F.substring(digits, 1, 3)), near("password", "secret"), near("default", "the"), False),
        (F.concat_ws("/", word(1), word(2), F.concat(word(3), F.substring(digits, 1, 3), F.lit(".html"))), near("href", "path"), near("see", "at", "page"), False),
        (F.substring(digits, 1, 16), none, near("order", "phone", "the", "number"), False),
        (F.concat_ws("-", F.substring(digits, 1, 3), F.substring(digits, 4, 4), F.substring(digits, 8, 4)), none, near("call", "tel", "the"), False),
        (F.concat(word(1), word(2), word(3), F.substring(digits, 1, 2)), none, near("the", "of", "and"), False),
        (F.concat(near("AKIA", "ASIA"), F.upper(F.substring(letters, 1, 16))), none, near("of", "the", "key", "and"), True),
        (cut(letters, 14, 40), secret_key, near("the", "set", "export"), True),
        (cut(mixed, 7, 12), secret_key, near("the", "set", "de"), True),
        (F.concat(near("T", "r", "K"), F.substring(letters, 1, 4), near("@", "!", "#", "$", "%"), F.substring(mixed, 6, 5), near("!", "", "%")), secret_key, near("the", "set", "und"), True),
        (F.concat(word(1), near("@", "!", "#", "$", "%"), word(2), near("!", "", "$")), secret_key, near("the", "set", "und"), True),
        (F.concat(word(1), F.substring(digits, 1, 3)), near("password", "passwd", "pwd", "PASSWORD", "url_password"), near("the", "set", "und"), True),
        (F.concat(F.lower(F.substring(letters, 1, 6)), cut(digits, 1, 3)), near("password", "passwd", "pwd", "passphrase", "db_password"), near("the", "my", "und"), True),
        (prose(1), none, near("the", "of", "and", "die", "la"), False),
        *((case(F.concat(*(syllable(k) for k in range(n)))), none, near("the", "of", "and", "secret", "die", None), False) for case in (F.lower, F.initcap, F.upper) for n in (5, 7)),
        (prose(1), none, near("secret", "access token", "password", "private"), False),
        (prose(1), secret_key, near("the", "a", "error"), False),
        (F.concat(prose(1), near("-", ".", "/", "_"), prose(2)), near(None, None, "path", "title"), near("the", "of", "und"), False),
        (F.concat(F.lit("//www."), word(1), F.lit(".com/"), prose(2)), near("https", "http"), near("see", "at"), False),
        (F.concat(word(1), near("_", "-", ""), word(2)), secret_key, near("the", "a", "error"), False),
    ]
    pick = F.col("id") % len(kinds)
    chosen = lambda k: reduce(lambda so_far, x: so_far.when(pick == x[0], x[1][k]), list(enumerate(kinds))[1:], F.when(pick == 0, kinds[0][k]))
    secret = F.when(pick.isin([k for k, x in enumerate(kinds) if x[3]]), 1.0).otherwise(0.0)
    return ids.select(chosen(0).alias("value"), chosen(1).alias("key"), chosen(2).alias("left"), F.lit("and").alias("right"), near("src/app", "tests/fixture", "docs/page", "src3").alias("path"), secret.alias("secret"))


def fit(findings: DataFrame, trees: int = 24, depth: int = 6, seed: int = 11, most_rows: int = 20_000) -> RandomForestClassificationModel:
    """A forest on at most most_rows labelled findings; columns value, key, left, right, path, secret (1 or 0)."""
    cols = features(*(F.col(c) for c in ("value", "key", "left", "right", "path")))
    rows = written(findings.filter(F.col("value").isNotNull() & (F.length("value") > 0) & F.col("secret").isNotNull()).limit(most_rows), "findings")
    table = written(rows.select(F.col("secret").cast("double").alias("label"), *(c.alias(n) for c, n in zip(cols, FEATURES, strict=True))), "labelled")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table))


def as_column(model: RandomForestClassificationModel, cols: list[Column]) -> Column:
    """The forest's probability of a secret, as nested conditions over the features."""

    def tree(node) -> Column:
        if node.numDescendants() == 0:
            stats = list(node.impurityStats().stats())
            return F.lit(float(stats[1] / sum(stats)))
        split = node.split()
        return F.when(cols[split.featureIndex()] <= F.lit(float(split.threshold())), tree(node.leftChild())).otherwise(tree(node.rightChild()))

    trees = [tree(t._call_java("rootNode")) for t in model.trees]
    return reduce(lambda a, b: a + b, trees) / F.lit(float(len(trees)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.transform(F.array(value), use)[0]


def escaped(text: Column) -> Column:
    """text without the characters that mark candidates, which few texts hold."""
    out = text
    for c, code in _ESCAPED.items():
        out = F.replace(out, F.lit(c), F.lit(_ESCAPE + code))
    return F.when(text.rlike(f"[{_ESCAPE}{_OPEN}{_SHUT}]"), out).otherwise(text)


def restored(text: Column) -> Column:
    out = text
    for c, code in reversed(_ESCAPED.items()):
        out = F.replace(out, F.lit(_ESCAPE + code), F.lit(c))
    return F.when(text.contains(_ESCAPE), out).otherwise(text)


def parted(text: Column) -> Column:
    """The text cut at its candidates, in one pass: what is no candidate at even places, candidates at odd ones."""
    return F.split(F.regexp_replace(escaped(text), CANDIDATE, _MARKED), f"[{_OPEN}{_SHUT}]")


def judged(parts: Column, model: RandomForestClassificationModel, path: Column, limit: float) -> Column:
    """For each candidate of a parted text: place, key, value, probability, secret."""
    path = F.coalesce(path.cast("string"), F.lit(""))

    def one(i: Column) -> Column:
        before, after = F.substring(F.get(parts, 2 * i), -160, 160), F.substring(F.get(parts, 2 * i + 2), 1, 60)
        value = F.regexp_replace(F.get(parts, 2 * i + 1), _TAIL, "")
        key = F.when(after.startswith("@") & before.rlike(_URL), "url_password").otherwise(F.regexp_extract(before, _KEY, 1))
        left, right = F.regexp_extract(before, r"(\S*\s+\S*\s+|\S*\s+)\S*$", 1), F.regexp_extract(after, r"^\S*\s+(\S{1,30})", 1)
        seen = let(F.struct(value.alias("v"), key.alias("k")), lambda x: F.struct(x["v"].alias("v"), x["k"].alias("k"), F.array(*features(x["v"], x["k"], left, right, path)).alias("f")))
        chance = lambda x: as_column(model, [x["f"][k] for k in range(len(FEATURES))])
        found = let(seen, lambda x: F.struct(x["k"].alias("key"), x["v"].alias("value"), chance(x).alias("probability")))
        return let(found, lambda x: F.struct(i.alias("place"), x["key"].alias("key"), x["value"].alias("value"), x["probability"].alias("probability"), ((x["probability"] >= limit) & (x["value"] != "")).alias("secret")))

    none = F.array().cast("array<struct<place:int,key:string,value:string,probability:double,secret:boolean>>")
    candidates = F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1), one)
    return F.when(F.size(parts) > 1, candidates).otherwise(none)


def scan(docs: DataFrame, model: RandomForestClassificationModel, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", limit: float = 0.5) -> DataFrame:
    """A row for each candidate: doc_id, place (among the text's candidates, from 0), key (or ""), value, probability, secret (false: removed as a false finding).

    Null and empty texts have no candidates; repeated rows are scanned each; a null path is no path; the whole text counts, and its
    candidates are found in one pass, so time grows in proportion to it. Other columns, of any name, are left out. No shuffle.
    """
    path = F.col(f"`{path_col}`") if path_col else F.lit("")
    found = let(parted(F.col(f"`{text_col}`")), lambda parts: judged(parts, model, path, limit))
    # explode would have its filter pushed down, which puts the work in twice.
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.explode_outer(F.when(F.col(f"`{text_col}`").isNotNull(), found)).alias("x"))
    return rows.filter("x is not null").select("doc_id", "x.place", "x.key", restored(F.col("x.value")).alias("value"), "x.probability", "x.secret")


def redact(docs: DataFrame, model: RandomForestClassificationModel, text_col: str = "text", path_col: str | None = "source", limit: float = 0.5, mask: str = "[SECRET]") -> DataFrame:
    """docs with every secret in the text replaced by mask; all rows stay, and other columns, of any name, are as they were.

    A secret is cut out at its own place. Candidates of an equal value, and pieces between white space, quotes, brackets, = : , ; and & that
    equal it, go too, whatever stands beside them. Null and empty texts stay as they are; repeated rows are masked each. A text is read
    once, whatever the number of its secrets.
    """
    path = F.col(f"`{path_col}`") if path_col else F.lit("")
    text = F.col(f"`{text_col}`")

    def clean(x: Column) -> Column:
        """From parts, found, and the distinct secret values, dealt to PARTS where they are many."""
        few, each = F.size(x["values"]) <= 32, x["dealt"]
        known = lambda v: F.when(few, F.array_contains(x["values"], v)).otherwise(F.array_contains(F.get(each, F.pmod(F.hash(v), F.lit(PARTS))), v))
        plain = lambda p: F.array_join(F.transform(F.split(p, _PIECES), lambda w: F.when((F.length(w) >= 6) & known(w), F.lit(mask)).otherwise(w)), "")
        value = lambda p, f: F.when(f["secret"] | known(f["value"]), F.concat(F.lit(mask), F.substring(p, F.length(f["value"]) + 1, F.length(p)))).otherwise(p)
        return F.array_join(F.transform(x["parts"], lambda p, k: F.when(k % 2 == 0, plain(p)).otherwise(value(p, F.get(x["found"], F.floor(k / 2).cast("int"))))), "")

    def dealt(x: Column) -> Column:
        parts = F.when(F.size(x["values"]) > 32, F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda b: F.filter(x["values"], lambda v: F.pmod(F.hash(v), F.lit(PARTS)) == b)))
        return F.struct(x["parts"].alias("parts"), x["found"].alias("found"), x["values"].alias("values"), parts.alias("dealt"))

    def masked(x: Column) -> Column:
        values = F.array_distinct(F.transform(F.filter(x["found"], lambda f: f["secret"]), lambda f: f["value"]))
        whole = let(F.struct(x["parts"].alias("parts"), x["found"].alias("found"), values.alias("values")), lambda y: let(dealt(y), clean))
        return F.when(F.exists(x["found"], lambda f: f["secret"]), restored(whole)).otherwise(text)

    return docs.withColumn(text_col, F.when(text.isNotNull(), let(let(parted(text), lambda p: F.struct(p.alias("parts"), judged(p, model, path, limit).alias("found"))), masked)))
