"""Secret scans: candidates by pattern, and a random forest that removes false positives.

Candidates are values behind a name and a sign (`name = "value"`), long runs of key characters, passwords in URLs
(`scheme://user:password@host`), and the bodies of private keys in PEM blocks. A candidate is described by its length, its
transitions between character classes, how much of it is made of dictionary fragments, whether it stands in a path, and
the words on both sides. A forest fitted on labelled findings decides. Everything on the way
is DataFrame functions: candidates, features, and the forest, whose trees become CASE expressions.

The labelled findings are made by rule from numbered rows: random keys, hex tokens and passwords, with and without telling
names, against digests, UUIDs, paths, numbers, identifiers and long words.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenguard.llm.common import materialize, table

# A value goes to the closing quote, or to white space without the marks that end a sentence or bracket there. The parameter
# of a URL that follows is not part of it, and a sign before another named secret has that one's value, not its own.
# The colon behind the user of a URL is no such sign: what follows is a password up to the @.
NAME_IN_FRONT = r"""(?=["'\s:=])(?<=[\p{L}\p{N}_])["']?\s*+(?:(?<!://[\w.%+\-]{1,64}):(?!//)=?|={1,3}>?)\s*+|(?<==)(?<=[\p{L}\p{N}_]={1,2})\s*+"""
VALUE = r"""(?<=")[^"\s]{8,}+(?=")|(?<=')[^'\s]{8,}+(?=')|(?!\w{0,30}(?i:pass|pwd|secret|token|key|auth|cred)\w{0,20}[=:])(?:[^\s"'&?.,;:)\]}>]|[&?](?!\w{1,40}=)|[.,;:)\]}>]++(?![\s"']|$)){4,}+"""
PEM = r"(?<=KEY-----)(?<=-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY-----)(?:[^-]++|-(?!----))++(?=-----END )"  # with the lines of its head
IN_URL = r"(?<=:)(?<=[a-z]://[\w.%+\-]{0,64}:)[^\s/@:\"']{6,}+(?=@[\w\[])"
RUN = r"(?<![A-Za-z0-9+/_.\-])[A-Za-z0-9+/_.\-]{16,}={0,2}(?![A-Za-z0-9+/_\-])"
#: A key in a PEM block or URL, the whole value of an assignment (the third group), or a run of key characters that stands alone.
CANDIDATE = rf"""({PEM}|{IN_URL})|((?:{NAME_IN_FRONT})["']?+)({VALUE})|({RUN})"""
LEAST = 8  # characters of a value, but for passwords in URLs
AROUND = 40  # characters of a candidate's neighbourhood on each side
STEP = 256  # candidates of a text that are folded at a time

# fixed values: fragments common in ordinary words and identifiers
FRAGMENTS = "the and ing ion ent ati for ter hat tha ere con res ver all ons nce men ith ted ers pro thi wit are ess not ive was ect rea com eve per int est sta cti ica ist ear ain one our iti rat ell ant min lin tin ren ble name user file data list test time type code main line text path page index image style class value number string script module config license public common".split()
# fixed values: names that announce a secret, and names that announce a digest or another harmless identifier
SECRET_NAMES = "password passwd pwd secret token apikey api_key api-key access_key accesskey private_key credential bearer auth".split()
HARMLESS_NAMES = "sha1 sha256 sha512 md5 checksum digest commit revision uuid guid etag hash isbn build version session_id request_id trace".split()

def names(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def features() -> dict[str, Column]:
    """What the forest looks at, as expressions over value, before and after."""
    value, before, after = F.col("value"), F.lower("before"), F.lower("after")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / F.length(value)
    named = lambda words: before.rlike(names(words) + r"""[a-z0-9_]{0,8}["']?\s?[=:]*>?\s?["']?$""").cast("int")
    near = lambda words: (before.rlike(rf"\b{names(words)}\b") | after.rlike(rf"""\b{names(words)}\b(?!["']?\s?[:=])""")).cast("int")  # noqa: E731  (a name before a sign belongs to the next value)
    return {
        "length": F.length(value),
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "hex": share("[0-9a-f]"),
        "marks": share(r"[^\p{L}\p{N}]"),
        "transitions": share("(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[a-z0-9]|(?<=[0-9])[A-Za-z]"),
        "doubled": share(r"(.)(?=\1)"),
        "dictionary": 1 - F.length(F.regexp_replace(F.lower(value), "|".join(sorted(FRAGMENTS, key=len, reverse=True)), "")) / F.length(value),
        "longest_word": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(value, F.lit(r"\p{L}+"), F.lit(0)), F.length)), F.lit(0)),
        "separators": F.regexp_count(value, F.lit("[/.]")),
        "dashes": F.regexp_count(value, F.lit("-")),
        "in_path": (before.rlike(r"[/\\]$|://[^\s:]*$") | value.rlike(r"^\.{0,2}/|\.[a-z]{2,4}$|^[a-z]+://") | after.rlike(r"^\.[a-z]{2,4}\b|^/")).cast("int"),
        "assigned": before.rlike(r"""[\p{L}\p{N}_]["']?\s?[=:]+>?\s?["']?$""").cast("int"),
        "secret_name": named(SECRET_NAMES),
        "harmless_name": named(HARMLESS_NAMES),
        "secret_near": near(SECRET_NAMES),
        "harmless_near": near(HARMLESS_NAMES),
        "wrapped": (before.rlike("private key-----$") | (before.rlike("://[^\\s/]*:$") & after.rlike("^@"))).cast("int"),
        "address": before.rlike("@$").cast("int"),
        "known_prefix": value.rlike(r"^(AKIA|ASIA)[A-Z0-9]{16}$|^(ghp|gho|ghs|xox[bp]|sk|pk|rk)[_\-]|^AIza|^eyJ|^glpat-").cast("int"),
    }


FOUND = "array<struct<start:bigint,piece:int,value:string,before:string,after:string>>"


def marked(text: Column) -> Column:
    """The text cut at its candidates: each piece but the first has its candidate, a mark, and the text up to the next one.

    Marks are private characters; a text that holds them has another private one of equal length in their place."""
    return F.split(F.regexp_replace(F.translate(text, "\ue000\ue001", "\ue002\ue002"), CANDIDATE, "$2\ue000$1$3$4\ue001"), "\ue000")


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, start, piece, value, before, after): start counts characters from 0, piece the candidates of a text from 1.

    Offsets add up over the pieces, which are folded STEP by STEP, so that lists stay short however many there are."""
    parts = docs.select("doc_id", marked(F.col("text")).alias("parts")).where(F.size("parts") > 1)
    pieces = lambda i: F.transform(F.slice("parts", i * STEP + 2, F.lit(STEP)), lambda p: F.struct(F.substring_index(p, "\ue001", 1).alias("value"), F.substring_index(p, "\ue001", -1).alias("gap")))
    near = lambda x: F.right(F.regexp_replace(F.right(x, F.lit(256)), r"\s+", " "), F.lit(AROUND))
    state = lambda start, piece, last, found: F.struct(start.alias("start"), piece.alias("piece"), last.alias("last"), found.alias("found"))
    none = F.array().cast(FOUND)

    def one(a: Column, p: Column) -> Column:
        item = F.struct(a["start"].alias("start"), a["piece"].alias("piece"), p["value"].alias("value"), a["last"].alias("before"), F.left(p["gap"], F.lit(AROUND)).alias("after"))
        return state(a["start"] + F.length(p["value"]) + F.length(p["gap"]), a["piece"] + 1, near(F.concat(a["last"], p["value"], p["gap"])), F.array_append(a["found"], item))

    def step(a: Column, i: Column) -> Column:
        done = F.transform(F.array(F.aggregate(pieces(i), state(a["start"], a["piece"], a["last"], none), one)), lambda d: state(d["start"], d["piece"], d["last"], F.array_append(a["found"], d["found"])))
        return F.element_at(done, 1)

    head = F.element_at("parts", 1)
    begin = state(F.length(head).cast("long"), F.lit(1), near(head), F.array().cast(f"array<{FOUND}>"))
    steps = F.sequence(F.lit(0), F.floor((F.size("parts") - 2) / STEP).cast("int"))
    found = F.flatten(F.aggregate(steps, begin, step, lambda a: a["found"]))
    return parts.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.*").where((F.length("value") >= LEAST) | F.startswith("after", F.lit("@")))


def findings(spark: SparkSession, n: int = 8000, first: int = 0) -> DataFrame:
    """(value, before, after, label, kind): labelled findings with the numbers from `first`, half of them secrets; the same for
    every run. kind is the number of the template."""
    row = spark.range(first, first + n)
    text = F.concat(*[F.sha2(F.concat_ws(":", "id", F.lit(i)).cast("binary"), 256) for i in range(2)])
    number = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m)).cast("int")
    pick = lambda k, xs: F.element_at(F.array(*[F.lit(x) for x in xs]), number(k, len(xs)) + 1)
    base64 = F.regexp_replace(F.base64(F.unhex(text)), r"\s", "")
    upper = F.upper(F.translate(F.substring(base64, 1, 40), "+/=abcdefghij", "ABC2345672345"))
    word = lambda k: F.concat(pick(k, FRAGMENTS), pick(k + 1, FRAGMENTS), pick(k + 2, FRAGMENTS))
    uuid = F.concat_ws("-", *[F.substring(text, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    syllables = [c + v for c in "b ch d f g j l m n pr r sch st t th tr v z".split() for v in ("a", "en", "eau", "ier", "ó", "un")]
    foreign = F.concat(*[pick(50 + i, syllables) for i in range(7)])  # words of languages that the fragments don't know
    marks = [F.substring(F.lit("!@#$%^&*?~|(+"), 1 + number(60 + i, 13), F.lit(1)) for i in range(4)]
    chosen = F.concat(F.initcap(pick(70, FRAGMENTS)), number(71, 10000).cast("string"), marks[0], F.initcap(pick(72, FRAGMENTS)), marks[1], number(73, 100).cast("string"), F.substring(base64, 20, 4), marks[2])  # as people choose them
    random = F.concat(F.substring(base64, 1, 5), marks[0], F.substring(base64, 7, 6), marks[1], F.substring(base64, 14, 5), marks[2], F.substring(base64, 20, number(74, 8) + 1), marks[3])
    short = F.concat(F.substring(base64, 1, 3), marks[0], F.substring(base64, 7, 6))
    text_value = F.concat(pick(75, ["https://", "", "(", "<"]), word(80), pick(76, ["/", ",", "-", ".", "_"]), word(83), pick(77, ["", "/", "!", ");", ".html"]))
    digits = F.substring(F.regexp_replace(F.conv(F.substring(text, 1, 15), 16, 10), "^", "4"), 1, 16)
    # what stands in front, and behind
    plain = pick(1, ["of the ", "and ", "with ", "see ", "le ", "und ", "que "])
    named = F.concat(pick(2, SECRET_NAMES), pick(9, ["", "", "2", "_1"]), pick(4, [' = "', "=", ": ", ' : "', "='"]))
    harmless = F.concat(pick(5, HARMLESS_NAMES), pick(6, [" ", "=", ": ", " = "]))
    other = F.concat(pick(90, FRAGMENTS), pick(91, [": ", " = ", '="', ":"]))
    path = pick(7, ["https://example.org/", "/usr/lib/", "src/", "C:\\"])
    pem = F.concat(F.lit("-----BEGIN "), pick(100, ["", "RSA ", "EC ", "OPENSSH "]), F.lit("PRIVATE KEY-----"))
    login = F.concat(pick(101, ["https", "postgres", "ftp", "amqp"]), F.lit("://"), pick(102, FRAGMENTS), F.lit(":"))
    either = lambda a, b, k=2: F.when(number(8, k) == 0, a).otherwise(b)
    loud = either(plain, F.lit("!! "))
    on = pick(103, [" et", ". Then", "\n", ", and", ") in", " und", ""])
    said = F.concat(pick(104, [" is our ", " as ", " (", ", the ", " = "]), pick(105, SECRET_NAMES))
    explained = F.concat(pick(106, [" is the ", " as ", " (", ", the ", " = "]), pick(107, HARMLESS_NAMES))
    secrets = [
        (F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), either(plain, named), on), (F.substring(text, 1, 40), named, on), (F.substring(base64, 1, 40), named, on),
        (F.concat(pick(3, ["ghp_", "sk_", "xoxb-", "glpat-"]), F.substring(F.translate(base64, "+/=", "abc"), 1, 36)), either(plain, named), on),
        (F.substring(text, 1, 18), named, on), (F.substring(F.translate(base64, "+/", "!#"), 1, 14), named, on), (chosen, named, on), (random, named, on), (short, named, on),
        (F.when(number(124, 2) == 0, F.substring(base64, 3, 32)).otherwise(F.substring(text, 5, 32)), plain, said), (F.substring(text, 7, 40), plain, said), (F.concat(F.lit("\n"), base64, base64, F.lit("\n")), pem, F.lit("-----END ")),
        (F.when(number(125, 2) == 0, F.substring(F.translate(base64, "+/", "!#"), 5, 12)).otherwise(F.concat(word(126), number(129, 100).cast("string"))), login, F.lit("@db.example.org")), (chosen, login, F.lit("@localhost/x")),
        (F.concat(pick(110, FRAGMENTS), pick(111, FRAGMENTS), number(112, 100).cast("string")), login, F.lit("@example.org/x")),
        (F.concat(F.lit("\nProc-Type: 4,ENCRYPTED\nDEK-Info: "), pick(140, ["AES-128-CBC,", "DES-EDE3-CBC,"]), F.upper(F.substring(text, 1, 32)), F.lit("\n\n"), base64, base64, F.lit("\n")), pem, F.lit("-----END ")),
    ]
    others = [
        (F.substring(text, 1, 40), harmless, on), (uuid, either(plain, harmless), on), (F.concat_ws("/", word(10), word(13), word(16)), either(plain, path), on), (F.concat_ws("_", word(20), word(23), word(26)), either(harmless, plain, 3), on),
        (F.concat(F.initcap(word(30)), word(33), word(36)), plain, on), (F.initcap(foreign), either(plain, F.lit(". ")), on), (foreign, plain, on), (F.concat(word(40), F.initcap(word(43)), F.initcap(word(46))), plain, on),
        (digits, plain, on), (text_value, other, on), (F.concat(F.initcap(foreign), pick(78, ["", "!", "?", "-"])), other, on), (F.concat(word(86), pick(79, ["", "!", "#", "&"])), other, on),
        (F.upper(foreign), loud, on), (F.upper(F.concat(word(92), word(95))), loud, on), (F.substring(text, 9, 40), plain, explained), (F.substring(text, 3, 32), either(plain, harmless), explained),
        (F.concat(pick(113, ["mail", "www", "smtp", "post"]), number(114, 20).cast("string"), F.lit("."), either(F.lit("example"), word(115)), pick(118, [".com", ".org", ".de"])), F.concat(plain, pick(119, FRAGMENTS), F.lit("."), number(120, 100).cast("string"), F.lit("@")), either(on, F.concat(on, F.lit(" "), pick(121, SECRET_NAMES), F.lit(' = "')), 3)),
        (digits, plain, F.concat(on, F.lit(" "), pick(122, SECRET_NAMES), F.lit(' = "'))), (F.initcap(foreign), F.lit(". "), F.concat(F.lit(" x "), pick(123, SECRET_NAMES), F.lit(": "))),
        (F.concat(word(130), F.lit("."), word(133), pick(136, [".com", ".org", ".net", ".fr"])), F.concat(plain, pick(137, FRAGMENTS), F.lit("@")), either(on, F.concat(on, F.lit(" "), pick(138, SECRET_NAMES), F.lit(' = "')), 3)), (F.upper(uuid), either(plain, harmless), on),
    ]
    every = secrets + others
    kind = F.pmod("id", F.lit(len(every))).cast("int")
    choose = lambda i: F.element_at(F.array(*[x[i] for x in every]), kind + 1)
    made = row.select(choose(0).alias("value"), F.right(F.concat(F.lit("lorem ipsum dolor sit amet lorem ipsum dolor sit "), choose(1)), F.lit(AROUND)).alias("before"), choose(2).alias("behind"), (kind < len(secrets)).cast("int").alias("label"), kind.alias("kind"))
    quote = F.regexp_extract("before", "[\"']$", 0)
    return made.select("value", "before", F.left(F.concat(quote, "behind"), F.lit(AROUND)).alias("after"), "label", "kind")


def train(spark: SparkSession, trees: int = 30, depth: int = 7, seed: int = 7, learned: DataFrame | None = None) -> str:
    """A forest fitted on labelled findings, as a SQL expression of the features: the mean of its trees' votes.

    The findings are fixed and few; they are put in order in one partition, so that the forest is the same on any cluster."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    names = list(features())
    rows = materialize((findings(spark) if learned is None else learned).withColumns({k: v.cast("double") for k, v in features().items()}).select("label", *names).repartition(1).sortWithinPartitions("label", *names)).coalesce(1)
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=5).fit(VectorAssembler(inputCols=names, outputCol="x").transform(rows))

    def case(lines: list[str]) -> str:
        """A tree as printed (two lines for each split) as nested CASE; lines is used up."""
        head = lines.pop(0).strip()
        if head.startswith("Predict"):
            return f"{float(head.split(': ')[1])}D"
        k, threshold = re.match(r"If \(feature (\d+) <= (\S+)\)", head).groups()
        low = case(lines)
        lines.pop(0)
        return f"CASE WHEN {names[int(k)]} <= {float(threshold)!r}D THEN {low} ELSE {case(lines)} END"

    return f"({' + '.join(case(t.toDebugString.strip().splitlines()[1:]) for t in model.trees)}) / {trees}"


def scan(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, length, value, score, piece) of each secret in docs (doc_id, text): start counts characters from 0,
    piece the candidates of its text from 1.

    Null and empty texts have none, nor does an empty table. Texts are scanned whole, however long. Repeated rows report
    their secrets each; a row without a doc_id reports them under null. Candidates under the threshold are dropped, and one
    with just the threshold stays. Other columns, whatever their names, are left out."""
    forest = train(docs.sparkSession)
    found = candidates(docs).withColumns({k: v.cast("double") for k, v in features().items()})
    found = found.select("doc_id", "start", F.col("length").cast("int").alias("length"), "value", F.expr(forest).alias("score"), "piece")
    return found.where(F.col("score") >= threshold)


def redact(text: Column, secrets: Column, mark: str = "[SECRET]") -> Column:
    """text with its secrets replaced by mark; secrets is an array of their pieces' numbers (see scan), in order.

    The text is cut at all candidates and joined again, with a letter for each piece that says whether it is a secret."""
    gaps = F.transform(secrets, lambda x, i: F.concat(F.repeat(F.lit("0"), (x - F.when(i == 0, 0).otherwise(F.element_at(secrets, F.greatest(i, F.lit(1))))).cast("int") - 1), F.lit("1")))
    cut = lambda parts: F.transform(F.arrays_zip(F.slice(parts, 2, F.size(parts)).alias("piece"), F.split(F.array_join(gaps, ""), "").alias("secret")), lambda x: F.concat(
        F.when(x["secret"] == "1", mark).otherwise(F.substring_index(x["piece"], "\ue001", 1)), F.substring_index(x["piece"], "\ue001", -1)))
    once = F.transform(F.array(marked(text)), lambda parts: F.concat(F.element_at(parts, 1), F.array_join(F.filter(cut(parts), lambda x: x.isNotNull()), "")))
    return F.element_at(once, 1)


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("piece")
