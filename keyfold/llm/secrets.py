"""Secret scans with DataFrame functions only: candidates by pattern, false positives removed by a random forest.

Candidates are quoted values, values assigned to key-like names with or without quotes, passwords in URLs, tokens with a known
prefix (in a path too), and long tokens of the secret alphabet; the forest rejects the false ones.
Splitting a text at its candidates gives every candidate's surroundings and place. The forest reads the candidate's
length, its character transitions (changes of class, vowels after consonants, repeats), how much of it dictionary words
cover, its path (slashes, dots and file-like endings in and before it) and neighbouring words. It is trained on the driver from
labelled findings, whose features the same DataFrame expressions compute, and applied as nested SQL conditions.

``labelled_findings`` makes such findings by rule and seed (credentials of public formats against digests, ids, paths,
identifiers, placeholders and prose); another table with text and is_secret may be given, of which at most
``MOST_LABELLED`` rows are used.

Defined results: a null or empty text gives no row; each occurrence is a row, with its start in characters; rows that
repeat give their rows again; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import base64
import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .forest import Forest

MOST_LABELLED, LEAST_SCORE, SEED, BLOCK = 20_000, 0.5, 20240301, 256
KNOWN = r"(?:(?:AKIA|ASIA)[A-Z0-9]{16}|(?:ghp_|gho_|sk_live_|sk-|xox[bp]-|AIza|eyJ)[A-Za-z0-9_\-]{16,})"
# a known prefix ends a long token before it, save after a letter or digit, where short prefixes occur by chance
LONG = rf"(?:(?!(?<![A-Za-z0-9]){KNOWN})[A-Za-z0-9+/_.\-]){{20,}}+={{0,2}}"
NAMED = r"(?<=[=: \t\"'])(?<=[=:][ \t]{0,8}[\"']?)(?<=(?i:passw(?:or)?d|passphrase|pwd|secret|token|credentials?|auth|api[_ -]?key|access[_ -]?key|private[_ -]?key|secret[_ -]?key)[\"']?[ \t]{0,8}[=:][ \t]{0,8}[\"']?)(?:(?!&\w+=)[^\s\"'`]){3,}[^\s\"'`.,;:)\]}>&]"
URL_PASSWORD = r"(?<=:)(?<=://[^\s/:@\"']{0,128}:)[^\s/@\"']+(?=@)"
QUOTED = r"(?<=[\"'])(?<=[=:][ \t]{0,8}[\"'])[^\s\"']{8,}(?=[\"'])"
CANDIDATE = rf"{KNOWN}|{URL_PASSWORD}|{NAMED}|{LONG}|{QUOTED}"
# Words that mark credentials, words that mark other values, and common words for dictionary coverage.
SECRET_WORDS = r"(?i)(token|secret|passw(or)?d|passwd|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|auth|bearer|aws|client[_ -]?id)"
OTHER_WORDS = r"(?i)((?<![a-z])(sha1|sha256|md5|digest|commit|checksum|hash|uuid|etag|revision|example|sample|dummy|placeholder|test)(?![a-z])|changeme|xxxx|http|href|src=|www)"
DICTIONARY = "about access account action after again all and any api app are back base been build but call can case change client code common config content control core data date default demo dev document download error example field file first for from get group guide has have help home html http image index info input insert item key lang last library license line link list local login main make management manager map message model module more name new next node not number object option order other output package page part password path place point post process product program project public query read report request response result return root sample search secret section server service session set setting some source start state status string style system table team test text that the then this time title token tool type update user utils value version video view was web when which will with word work your".split()
FEATURES = ["size", "changes", "vowel_pairs", "repeats", "digit_share", "upper_share", "hex_only", "covered", "slashes", "file_like", "dashes", "path_before", "secret_word", "other_word", "assigned", "quoted", "known_prefix", "distinct_share"]


def candidates(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """Columns ``keep`` (as k0, k1, …), start, value, before and after of every candidate."""
    found = df.where(F.col(text).rlike(CANDIDATE)).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)], F.col(text).alias("kf_text"))
    cut = found.select(*[f"k{i}" for i in range(len(keep))], F.inline(F.array(F.struct(F.regexp_extract_all("kf_text", F.lit(f"({CANDIDATE})"), F.lit(1)).alias("hits"), F.split("kf_text", CANDIDATE, -1).alias("gaps")))))
    names = [f"k{i}" for i in range(len(keep))]
    step = F.transform("hits", lambda hit, i: F.length(F.element_at("gaps", i + 1)) + F.when(i > 0, F.length(F.element_at("hits", F.greatest(i, F.lit(1))))).otherwise(0))
    # starts are running sums of steps: of whole runs of BLOCK first, so that no text takes the square of its candidates
    summed = lambda array, first, n: F.aggregate(F.slice(array, first, n), F.lit(0), lambda a, x: a + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("steps") - 1) / BLOCK).cast("int")), lambda b: summed("steps", b * BLOCK + 1, F.lit(BLOCK)))
    stepped = cut.where(F.size("hits") > 0).select(*names, "hits", "gaps", F.inline(F.array(F.struct(step.alias("steps")))))
    stepped = stepped.select("*", F.inline(F.array(F.struct(blocks.alias("blocks")))))
    stepped = stepped.select("*", F.inline(F.array(F.struct(F.transform("blocks", lambda _, b: summed("blocks", F.lit(1), b)).alias("bases")))))

    def placed(hit: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        start = F.element_at("bases", block + 1) + summed("steps", block * BLOCK + 1, i % BLOCK + 1)
        before, after = F.right(F.element_at("gaps", i + 1), F.lit(48)), F.left(F.element_at("gaps", i + 2), F.lit(24))
        return F.struct(start.alias("start"), hit.alias("value"), before.alias("before"), after.alias("after"))

    return stepped.select(*names, F.inline(F.transform("hits", placed)))


def _count(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)).cast("double")


def featured(df: DataFrame) -> DataFrame:
    """``df`` with value, before and after, and the features as columns."""
    v, n = F.col("value"), F.greatest(F.length("value"), F.lit(1)).cast("double")
    changes = sum((_count(v, p) for p in (r"[a-z](?=[^a-z])", r"[A-Z](?=[^A-Z])", r"[0-9](?=[^0-9])", r"[^A-Za-z0-9](?=[A-Za-z0-9])")), F.lit(0.0))
    word = "(?i)(" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")"
    columns = {
        "size": n,
        "changes": changes / n,
        "vowel_pairs": _count(v, r"(?i)[b-df-hj-np-tv-xz](?=[aeiou])") / n,
        "repeats": _count(v, r"(.)(?=\1)") / n,
        "digit_share": _count(v, r"[0-9]") / n,
        "upper_share": _count(v, r"[A-Z]") / n,
        "hex_only": v.rlike(r"^[0-9a-fA-F]+$").cast("double"),
        "covered": (n - F.length(F.regexp_replace(v, word, ""))) / n,
        "slashes": _count(v, r"/"),
        "file_like": v.rlike(r"(?i)\.(py|js|ts|c|h|cpp|java|go|rs|md|txt|html?|css|json|ya?ml|xml|png|jpe?g|gif|svg|pdf|zip|com|org|net)$").cast("double"),
        "dashes": _count(v, r"[-_.]"),
        "path_before": F.col("before").rlike(r"(?i)(/|\\|\.com|\.org|\.net|://|src=.?|href=.?)\S*$").cast("double"),
        "secret_word": F.col("before").rlike(SECRET_WORDS).cast("double"),
        "other_word": F.concat(F.col("before"), F.lit(" "), v, F.lit(" "), F.col("after")).rlike(OTHER_WORDS).cast("double"),
        "assigned": F.col("before").rlike(r"[=:]>? *[\"']?$").cast("double"),
        "quoted": F.col("before").rlike(r"[\"']$").cast("double"),
        "known_prefix": v.rlike(r"^(AKIA|ASIA|ghp_|gho_|sk_live_|sk-|xox[bp]-|AIza|eyJ)").cast("double"),
        "distinct_share": F.size(F.array_distinct(F.split(v, ""))) / n,
    }
    return df.select("*", F.inline(F.array(F.struct(*[columns[k].alias(k) for k in FEATURES]))))


def labelled_findings(seed: int = SEED, each: int = 130) -> list[tuple[str, int]]:
    """(text around one candidate, is_secret) of every kind, ``each`` times."""
    rng = random.Random(seed)
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    hexa, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    words = lambda n, by: by.join(rng.choice(DICTIONARY) for _ in range(n))
    syllables = lambda n: "".join(rng.choice(["th", "er", "on", "an", "in", "ed", "es", "ou", "la", "ch", "eau", "ung", "mente", "cion", "qu", "re", "st", "heit"]) for _ in range(n))
    name = lambda: rng.choice(["token", "secret", "password", "api_key", "access_key", "auth_token", "client_secret", "private_key", "aws_secret_key"])
    lead = lambda: syllables(2) + " " + syllables(1) + " "
    assign = lambda: rng.choice([' = "', "='", ': "', '="', "=", ": "])
    close = lambda a: a[-1] if a[-1] in "\"'" else ""
    strong = lambda: rng.choice([lambda: pick(hexa, rng.choice([32, 40, 64])), lambda: pick(alnum, rng.randint(20, 48)), lambda: base64.b64encode(rng.randbytes(rng.randint(18, 40))).decode()])()

    def marked(n):
        return pick(string.ascii_lowercase, 2) + pick(alnum + "!@#$%&*", n - 4) + pick(string.digits, 1) + pick(string.ascii_letters, 1)

    def assigned(key, value):
        a = assign()
        return f"{lead()}{key}{a}{value}{close(a)} {syllables(3)}"

    kinds = [
        (1, lambda: assigned(name(), strong())),
        (1, lambda: assigned(name(), strong())),
        (1, lambda: f"{lead()}{rng.choice(['AKIA', 'ASIA'])}{pick(string.ascii_uppercase + string.digits, 16)} {syllables(2)}"),
        (1, lambda: f"{lead()}{rng.choice(['ghp_', 'sk_live_', 'sk-', 'xoxb-', 'AIza', 'eyJ'])}{pick(alnum, rng.randint(24, 40))} {syllables(2)}"),
        (1, lambda: f'{lead()}password{rng.choice([" = ", ": ", "="])}"{pick(alnum + "!@#$%&*", rng.randint(12, 19))}" {syllables(2)}'),
        (1, lambda: f"{lead()}Authorization: Bearer {pick(alnum, rng.randint(30, 60))} {syllables(2)}"),
        (0, lambda: f"{lead()}{rng.choice(['commit', 'sha256', 'md5', 'checksum', 'etag', 'revision'])}{rng.choice([' ', ': ', '='])}{pick(hexa, rng.choice([32, 40, 64]))} {syllables(2)}"),
        (0, lambda: f"{lead()}{rng.choice(['id', 'uuid', 'session', 'key'])}={'-'.join(pick(hexa, n) for n in (8, 4, 4, 4, 12))} {syllables(2)}"),
        (0, lambda: f"{lead()}/{words(rng.randint(3, 6), '/')}/{words(2, '_')}.{rng.choice(['py', 'html', 'json', 'txt'])} {syllables(2)}"),
        (0, lambda: f"{lead()}https://www.{words(2, '-')}.com/{words(rng.randint(2, 5), '/')} {syllables(2)}"),
        (0, lambda: f"{lead()}{words(rng.randint(4, 7), rng.choice(['_', '-', '.']))} {syllables(2)}"),
        (0, lambda: f"{lead()}{syllables(rng.randint(8, 14))}{rng.choice([' ', '. ', ', '])}{syllables(2)}"),
        (0, lambda: assigned(name(), rng.choice(["x" * rng.randint(20, 32), "your_" + words(3, "_"), "changeme_" + words(2, "_") + "_please", "example_" + words(3, "_"), "0" * 32, "1234567890" * 3, "<insert-" + words(3, "-") + ">"]))),
        (0, lambda: f"{lead()}{'.' * rng.randint(20, 40)}{syllables(2)}"),
        (0, lambda: f"{lead()}{rng.choice('-=_') * rng.randint(20, 60)} {syllables(2)}"),
        (0, lambda: f"{lead()}{pick(string.digits, rng.randint(20, 28))} {syllables(2)}"),
        (0, lambda: f'{lead()}{rng.choice(["title", "name", "value", "label"])} = "{words(rng.randint(2, 3), "-")}" {syllables(2)}'),
        (0, lambda: f"{lead()}{words(2, '.')}.{pick(string.digits, 2)}@mail{pick(string.digits, 1)}.{words(1, '')}.example.com {syllables(2)}"),
        (1, lambda: f"{lead()}{rng.choice(['DB_PASSWORD=', 'password: ', 'pwd=', 'passwd = ', 'SECRET=', 'api_key: '])}{marked(rng.randint(8, 22))} {syllables(2)}"),
        (1, lambda: f"{lead()}{rng.choice(['postgres', 'mysql', 'amqp', 'https'])}://{words(1, '')}:{marked(rng.randint(8, 16)).replace('@', 'a')}@{words(1, '')}.{words(1, '')}/{words(1, '')} {syllables(2)}"),
        (1, lambda: f"{lead()}https://{pick(string.ascii_lowercase, 4)}/{pick(string.ascii_lowercase, 4)}/{rng.choice(['AKIA', 'ASIA'])}{pick(string.ascii_uppercase + string.digits, 16)} {syllables(2)}"),
        (0, lambda: f"{lead()}{rng.choice(['password: ', 'token: ', 'secret = ', 'pwd=', 'api_key: ', 'auth='])}{rng.choice([words(1, ''), syllables(rng.randint(2, 4)), 'None', 'null', 'true', 'false', 'string', 'required', 'self.' + words(1, ''), 'changeme', '********', 'xxxxxxxx', '${' + words(2, '_').upper() + '}'])} {syllables(2)}"),
    ]
    return [(make(), label) for label, make in kinds for _ in range(each)]


def train(spark: SparkSession, labelled: DataFrame | None = None) -> Forest:
    """A forest from labelled findings: text with one candidate (its first counts), is_secret 0 or 1."""
    if labelled is None:
        labelled = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(labelled_findings())], "id int, text string, is_secret int")
    found = candidates(labelled.where("is_secret is not null").limit(MOST_LABELLED), ["is_secret", "text"], "text")
    rows = featured(found.groupBy("k1", "k0").agg(F.min(F.struct("start", "value", "before", "after")).alias("first")).select("k1", "k0", "first.*"))
    got = rows.select("k1", "k0", *FEATURES).orderBy("k1", "k0").limit(MOST_LABELLED).collect()
    x = np.array([[r[f] for f in FEATURES] for r in got], float).reshape(-1, len(FEATURES))
    return Forest.train(FEATURES, x, np.array([r["k0"] for r in got]))


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", forest: Forest | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """doc_id, start, length, sha256 (of the value), score and is_secret of every candidate."""
    forest = forest or train(df.sparkSession)
    rows = featured(candidates(df, [doc_id], text))
    scored = rows.select(F.col("k0").alias("doc_id"), "start", F.length("value").alias("length"), F.sha2("value", 256).alias("sha256"), F.inline(F.array(F.struct(forest.column().alias("score")))))
    return scored.withColumn("is_secret", F.col("score") >= least)


def redact(df: DataFrame, findings: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with every value whose SHA-256 is among the document's secrets replaced by ``[secret]``."""
    hits = findings.where("is_secret").groupBy(F.col("doc_id").alias("kf_id")).agg(F.collect_set("sha256").alias("kf_hits"))
    joined = df.join(hits, F.col(doc_id) == F.col("kf_id"), "left")
    values = F.filter(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(f"({CANDIDATE})"), F.lit(1))), lambda v: F.array_contains("kf_hits", F.sha2(v, 256)))
    clean = F.aggregate(values, F.col(text), lambda t, v: F.replace(t, v, F.lit("[secret]")))
    fixed = F.when(F.col("kf_hits").isNotNull(), clean).otherwise(F.col(text))
    return joined.select(*[fixed.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])
