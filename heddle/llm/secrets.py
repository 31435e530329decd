"""Secret scan: candidates by one pattern, false positives removed by a random forest.

All of it is DataFrame expressions. Candidates are runs of 16 or more key characters with
a digit or a known prefix, values of SHORTEST or more characters assigned to a credential
word (quoted ones up to their closing quote in the line), and private-key blocks, over
whole texts. Splitting a text at the candidates gives their neighbourhoods
and places. Features: length, shares of character classes, transitions between them,
distinct characters, dictionary coverage, known shapes, the neighbouring words, the path.
The forest is trained on labelled findings (``findings``, or ``labelled_findings`` below:
``FINDINGS`` rows made by rule) and compiled to nested CASE expressions; a candidate is a
secret when at least half of the trees say so.

Null and empty texts have no findings. Repeated rows have theirs each. A null path counts
as empty. Findings do not overlap and come in the order of the text. An empty table has no
findings. Very long texts and very many candidates are scanned whole, in time that grows in
proportion to them; columns of any name are kept. Not candidates: assigned values of fewer
than SHORTEST characters, free-standing runs of fewer than 16 or with neither a digit nor a
known prefix.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FINDINGS, TREES, DEPTH, SEED = 16000, 24, 7, 7
BLOCK = 256  # candidates a block of the running sums
SHORTEST = 4  # characters of an assigned value
MASK = "[SECRET]"

# fixed values: words beside credentials, words beside harmless numbers, shapes of well-known keys
CREDENTIAL = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key"
HARMLESS = "commit|sha1|sha256|md5|checksum|revision|uuid|guid|digest|integrity|version|build|isbn|order|phone|card|invoice|base64|blob|etag|hash"
PREFIXES = "AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|xox[abprs]-|sk_live_|sk-|AIza|eyJ|glpat-|npm_"
KNOWN = f"^({PREFIXES}|-----BEGIN)"
FILLER = r"(.)\1{4,}|1234567|abcdefg|example|placeholder|changeme|your[_-]|xxxx|dummy|sample|insert"
DICTIONARY = (
    "access account address admin agent alpha android apple archive article asset author backup banner base beta block board branch bridge browser bucket build button cache camera canvas center change channel chart check "
    "client cloud code color column comment commit common config console content control core country create current custom data date debug default delete demo design detail device dialog digital docs document domain "
    "download draft editor element email engine entry error event example export feature field file filter final first folder format frame front gallery game general global graph green group guide handler header health "
    "home host icon image import index info input insert install item java json label large latest layout level library light limit line link list local location login main manager master media member menu message method mobile "
    "model module name network news node number object office open option order output package page panel parent part pass password path photo place player plugin point policy post preview price print private process product "
    "profile project public python query read record release remote report request response result review root route sample scale schema screen script search secret section select server service session setting shape share short "
    "signal simple site size small social source space spring stack stage start state static status store stream string style summary super support switch system table target task team template test text theme thumb time title token "
    "tool total track update upload user value version video view visual web widget window word work world write year your"
)
PLACES = r"(?i)(test|spec|fixture|example|mock|sample|docs?/|\.md$|\.lock$|\.sum$|\.svg$|\.css$)"

# the quantifiers of a sign and of quoted text are possessive, which Java runs without recursion or going back
_SIGN = rf"(?i:{CREDENTIAL})[\"']?+[ \t]*+[:=]{{1,2}}+[ \t]*+"
_ASSIGN = rf"{_SIGN}[\"']?+"
_QUOTED = lambda q: rf"(?=(?:[^{q}\\\r\n]|\\.){{{SHORTEST}}})[^{q}\\\r\n]*+(?:\\.[^{q}\\\r\n]*+)*+"
_KEY = r"[A-Z0-9 ]{0,24}PRIVATE KEY(?: BLOCK)?-----"
CANDIDATE = (
    # from the BEGIN line to the next marker, which has to be its END line: every text is read once
    rf"-----BEGIN {_KEY}(?>[\s\S]*?-----(?=BEGIN |END ))END {_KEY}"
    rf"|{_SIGN}(?![\"']?-----BEGIN {_KEY})(?:\"{_QUOTED('\"')}(?=\")|'{_QUOTED("'")}(?=')|[\"']?+[^\s\"',;]{{{SHORTEST},}})"
    rf"|(?<![A-Za-z0-9+/_-])(?:(?=[A-Za-z+/_-]*[0-9])|(?={PREFIXES}))[A-Za-z0-9+/_-]{{16,}}={{0,2}}"
)
FEATURES = 19


def _share(value: Column, kind: str) -> Column:
    return (F.length(value) - F.length(F.regexp_replace(value, kind, ""))) / F.length(value)


def features(value: Column, left: Column, right: Column, path: Column) -> Column:
    """array<double> of FEATURES numbers; left and right: the neighbouring text."""
    n = F.length(value)
    yes = lambda test: F.when(test, 1.0).otherwise(0.0)
    words = "|".join(sorted(DICTIONARY.split(), key=len, reverse=True))
    flag = [
        F.least(n, F.lit(200)).cast("double"), _share(value, "[0-9]"), _share(value, "[A-Z]"), _share(value, "[a-z]"), _share(value, "[^A-Za-z0-9]"),
        F.size(F.regexp_extract_all(value, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+"), F.lit(0))) / n,
        F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(64)),
        yes(F.rlike(value, F.lit("^([0-9a-f]+|[0-9A-F]+)$")) & n.isin(32, 40, 56, 64)),
        _share(F.lower(value), words),
        yes(F.rlike(left, F.lit(rf"(?i)({CREDENTIAL})"))), yes(F.rlike(left, F.lit(rf"(?i)\b({HARMLESS})"))),
        yes(F.rlike(left, F.lit(r"[:=][ \t]*[\"']?$"))), yes(F.rlike(left, F.lit("[\"']$")) & F.rlike(right, F.lit("^[\"']"))),
        yes(F.rlike(value, F.lit(KNOWN))), yes(F.rlike(F.coalesce(path, F.lit("")), F.lit(PLACES))),
        _share(value, "/"), yes(F.rlike(F.lower(value), F.lit(FILLER))),
        yes(F.rlike(value, F.lit("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"))), yes(F.rlike(value, F.lit("^[0-9+-]+$"))),
    ]
    return F.array(*[c.cast("double") for c in flag])


def labelled_findings(spark: SparkSession, rows: int = FINDINGS) -> DataFrame:
    """value, left, right, path, label: candidates made by rule from a hash of their number."""
    base = spark.range(0, rows, 1, 1)
    hashed = lambda salt, kinds: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(kinds))
    hexes = F.sha2(F.concat_ws("-", F.lit("v"), F.col("id")), 256)
    packed = F.regexp_replace(F.base64(F.unhex(hexes)), "[=]", "")
    plain = F.regexp_replace(packed, "[+/]", "")
    digits = F.lpad(F.abs(F.xxhash64("id", F.lit(3))).cast("string"), 19, "4")
    pick = lambda salt, values: F.element_at(F.array(*map(F.lit, values)), (hashed(salt, len(values)) + 1).cast("int"))
    syllable = lambda salt: F.concat(pick(salt, "b c d f g k l m n p r s t v br ch st tr".split()), pick(salt + 100, "a e i o u ai ea ou é ö".split()), pick(salt + 200, ["", "", "n", "r", "s", "l", "nd", "st"]))
    noun = lambda salt: F.when(hashed(salt + 300, 3) == 0, pick(salt + 400, DICTIONARY.split())).otherwise(F.concat(syllable(salt), syllable(salt + 500), F.when(hashed(salt + 600, 2) == 0, syllable(salt + 700)).otherwise("")))
    word = F.concat_ws(" ", noun(11), noun(12), noun(13))
    credential = pick(21, ["token", "api_key", "secret", "password", "apikey", "access_key", "auth token", "client_secret", "TOKEN", "API-KEY", "PASSWORD"])
    assign = F.concat(F.col("w"), F.lit(" "), credential, pick(22, [' = "', "=", ": ", " = ", ': "', '="']))
    size = F.element_at(F.array(*map(F.lit, [32, 40, 64, 20, 24, 48])), (hashed(31, 6) + 1).cast("int"))
    cut = lambda text, length: F.substring(text, 1, length)
    sized = lambda text: F.when(size == 32, cut(text, 32)).when(size == 40, cut(text, 40)).when(size == 20, cut(text, 20)).when(size == 24, cut(text, 24)).otherwise(text)
    closes = F.when(hashed(23, 2) == 0, F.lit('" ')).otherwise(F.lit(" "))
    harmless = F.concat(F.col("w"), F.lit(" "), pick(24, ["commit ", "sha1 ", "md5: ", "checksum=", "uuid ", "revision ", "digest: ", "etag ", "integrity "]))
    space = F.concat(F.col("w"), F.lit(" "))
    kinds: list[tuple[Column, Column, int]] = [
        (sized(hexes), assign, 1), (sized(F.upper(hexes)), assign, 1), (sized(packed), assign, 1), (sized(plain), assign, 1), (cut(hexes, 40), assign, 1),
        (F.concat(F.lit("AKIA"), F.upper(cut(plain, 16))), space, 1), (F.concat(F.lit("ghp_"), cut(plain, 36)), space, 1), (F.concat(F.lit("eyJ"), packed), space, 1), (F.concat(F.lit("sk_live_"), cut(plain, 24)), space, 1),
        (F.concat(noun(14), F.substring(digits, 8, 4), F.lit("!"), cut(plain, 3)), assign, 1),
        (cut(digits, 16), space, 0), (F.concat(F.lit("+"), cut(digits, 17)), space, 0), (sized(hexes), harmless, 0), (cut(hexes, 40), harmless, 0),
        (F.concat_ws("-", cut(hexes, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12)), pick(25, ["id: ", "request ", "uuid=", "session "]), 0),
        (F.concat(noun(14), noun(15), noun(16), F.substring(digits, 9, 4)), space, 0), (F.concat_ws("/", noun(14), F.substring(digits, 5, 4), F.substring(digits, 10, 2), noun(15)), space, 0),
        (F.concat(noun(14), F.lit("-"), noun(15), F.lit("_"), F.substring(digits, 5, 8), F.lit("-large")), space, 0),
        (pick(26, ["changeme1234", "xxxxxxxxxxxxxxx1", "your_token_here_1", "example-key-000000", "placeholder0001", "aaaaaaaa11111111", "1234567812345678"]), assign, 0),
        (F.concat(F.lit("iVBORw0KGgo"), packed), F.lit("data:image/png;base64,"), 0), (cut(hexes, 40), space, 0),
        (F.concat(cut(noun(14), 3), F.substring(digits, 8, 2), pick(28, ["!", "$", "#", "%"])), assign, 1), (F.concat(noun(14), pick(28, [",", ";", " ", "&"]), cut(plain, 3), F.substring(digits, 8, 3)), assign, 1),
        (cut(F.regexp_replace(plain, "[0-9]", ""), 8), assign, 1), (F.concat_ws(" ", noun(14), noun(15), noun(16), noun(17)), assign, 1),
        (noun(14), assign, 0), (pick(29, DICTIONARY.split()), assign, 0),
        (pick(30, ["None", "null", "true", "false", "undefined", "required", "string", "make", "with", "this", "that", "from", "have", "will", "os.environ[", "process.env.KEY", "getenv(", "settings.KEY", "str", "${VALUE}"]), assign, 0),
    ]
    order = [0, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9, 10, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27]
    which = hashed(41, len(order))
    choose = lambda j: F.element_at(F.array(*[F.lit(kinds[k][j]) if j == 2 else kinds[k][j] for k in order]), (which + 1).cast("int"))
    path = F.element_at(F.array(F.lit(""), noun(18), F.concat(noun(18), F.lit("/"), noun(19), pick(27, [".py", ".js", ".go", ".env", ".yml"])), F.concat(F.lit("tests/test_"), noun(18)), F.concat(F.lit("docs/"), noun(18), F.lit(".md")), F.concat(noun(18), F.lit(".lock"))), (hashed(42, 6) + 1).cast("int"))
    rows_ = base.withColumn("w", word)
    return rows_.select("id", choose(0).alias("value"), choose(1).alias("left"), closes.alias("right"), path.alias("path"), choose(2).cast("double").alias("label"))


_forests: dict[tuple, list] = {}


def train(findings: DataFrame, *, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list:
    """The forest as nested tuples: (feature, threshold, left, right) or the class at a leaf."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = findings.select(array_to_vector(features(F.col("value"), F.col("left"), F.col("right"), F.col("path"))).alias("features"), "label")
    fitted = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=4, featureSubsetStrategy="onethird").fit(rows)
    return [_parse(iter(tree.toDebugString.splitlines()[1:])) for tree in fitted.trees]


def _parse(lines):
    line = next(lines).strip()
    if line.startswith("Predict"):
        return int(float(line.split(":")[1]))
    feature, cut = re.match(r"If \(feature (\d+) <= ([-\d.E]+)\)", line).groups()
    left = _parse(lines)
    next(lines)  # Else
    return int(feature), float(cut), left, _parse(lines)


def forest(spark: SparkSession, findings: DataFrame | None = None) -> list:
    """Trained once per application on the default findings."""
    if findings is not None:
        return train(findings)
    key = (spark.sparkContext.applicationId,)
    if key not in _forests:
        _forests[key] = train(labelled_findings(spark))
    return _forests[key]


def votes(trees: list, array: str) -> str:
    """SQL: the share of trees that say secret, over an array of features."""

    def one(node) -> str:
        if isinstance(node, int):
            return f"{node}"
        feature, cut, left, right = node
        if left == right:
            return one(left)
        return f"CASE WHEN {array}[{feature}] <= {cut!r}D THEN {one(left)} ELSE {one(right)} END"

    return "(" + " + ".join(one(tree) for tree in trees) + f") / {len(trees)}.0D"


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(values: Column) -> Column:
    """The sums of a long array up to each place, in time proportional to its length (nearly): blocks first, then inside them."""
    zero = F.lit(0).cast("long")
    plus = lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x))
    block = lambda own, b: F.slice(own, b * BLOCK + 1, F.lit(BLOCK))
    number = lambda own: F.sequence(F.lit(0), F.floor((F.size(own) - 1) / BLOCK).cast("int"))

    def summed(own: Column) -> Column:
        totals = F.transform(number(own), lambda b: F.aggregate(block(own, b), zero, lambda a, x: a + x))
        starts = F.aggregate(totals, F.array(zero), plus)
        inside = lambda begin: F.transform(number(own), lambda b: F.slice(F.aggregate(block(own, b), F.array(F.element_at(begin, b + 1)), plus), F.lit(2), F.lit(BLOCK)))
        return F.flatten(_let(starts, inside))

    return _let(values, lambda own: F.when(F.size(own) > 0, summed(own)).otherwise(own))


def scanned(docs: DataFrame, trees: list, text: Column, path: Column) -> tuple[DataFrame, str, str]:
    """docs with two columns more, and their names: the text before the first candidate, and the scored candidates in order, each with the text up to the next."""
    cut, items, found, head = (_fresh(docs, f"heddle_{n}") for n in ("cut", "items", "found", "head"))
    whole = F.coalesce(text, F.lit(""))
    own = docs.withColumn(cut, F.struct(F.split(whole, CANDIDATE, -1).alias("parts"), F.regexp_extract_all(whole, F.lit(CANDIDATE), F.lit(0)).alias("matches")))

    def split(z: Column) -> Column:
        parts, matches = z["parts"], z["matches"]
        n = F.size(matches)
        before, after = F.slice(parts, F.lit(1), n), F.slice(parts, F.lit(2), n)
        each = F.zip_with(before, matches, lambda p, m: F.struct(p.alias("before"), m.alias("match")))
        each = F.zip_with(each, after, lambda x, p: F.struct(x["before"].alias("before"), x["match"].alias("match"), p.alias("rest")))
        ends = running_sums(F.transform(each, lambda x: (F.length(x["before"]) + F.length(x["match"])).cast("long")))

        def placed(x: Column, end: Column) -> Column:
            return _let(F.regexp_extract(x["match"], rf"^({_ASSIGN})?", 0), lambda prefix: _let(F.substr(x["match"], F.length(prefix) + 1), lambda value: F.struct(
                (end - F.length(value)).alias("start"), prefix.alias("prefix"), value.alias("value"), x["rest"].alias("rest"),
                F.when(F.length(prefix) > 0, "assigned").when(value.startswith("-----BEGIN"), "private_key").otherwise("key_like").alias("rule"),
                F.concat(F.right(x["before"], F.lit(48)), prefix).alias("left"), F.left(x["rest"], F.lit(24)).alias("right"),
            )))

        return F.zip_with(each, ends, placed)

    own = own.withColumn(items, F.transform(_let(F.col(cut), split), lambda x: F.struct(x["start"].alias("start"), x["prefix"].alias("prefix"), x["value"].alias("value"), x["rest"].alias("rest"), x["rule"].alias("rule"), features(x["value"], x["left"], x["right"], path).alias("f"))))
    scored = f"transform({items}, x -> named_struct('start', x.start, 'prefix', x.prefix, 'value', x.value, 'rest', x.rest, 'rule', x.rule, 'score', {votes(trees, 'x.f')}))"
    own = own.withColumn(found, F.expr(scored)).withColumn(head, F.element_at(F.col(cut)["parts"], 1))
    return own.drop(cut, items), head, found


def findings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, trees: list | None = None) -> DataFrame:
    """doc_id, start (code points before it), length, rule, value, score, is_secret: one row per candidate."""
    trees = trees or forest(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"), (F.col(path_col) if path_col else F.lit("")).alias("p"))
    own, _, found = scanned(own, trees, F.col("t"), F.col("p"))
    # explode() would have its inferred filter evaluate the whole scan once more
    each = own.select("doc_id", F.explode_outer(found).alias("x")).where("x IS NOT NULL")
    return each.select("doc_id", "x.start", F.length("x.value").cast("long").alias("length"), "x.rule", "x.value", "x.score", (F.col("x.score") >= 0.5).alias("is_secret"))


def redact(docs: DataFrame, *, text_col: str = "text", path_col: str | None = None, trees: list | None = None) -> DataFrame:
    """docs with every secret in the text replaced by MASK; null texts stay null, other columns as they are."""
    trees = trees or forest(docs.sparkSession)
    own, head, found = scanned(docs, trees, F.col(text_col), F.col(path_col) if path_col else F.lit(""))
    shown = F.transform(found, lambda x: F.concat(x["prefix"], F.when(x["score"] >= 0.5, MASK).otherwise(x["value"]), x["rest"]))
    joined = F.concat(F.col(head), F.array_join(shown, ""))
    return own.withColumn(text_col, F.when(F.col(text_col).isNull(), None).when(F.size(found) == 0, F.col(text_col)).otherwise(joined)).select(docs.columns)
