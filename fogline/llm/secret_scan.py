"""Secret scans: candidates by shape, false positives removed by a random forest. DataFrame and SQL functions only.

The forest sees a candidate's length, character classes and transitions, how much of it dictionary words cover, the path it
comes from and the words around it. It is trained from labelled findings: reviewed ones, or, where a corpus has none, ones
that are planted between words of its own documents, whose labels are known from what was planted and not from features.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fogline.functions.runtime import materialize

WHITE = r"[\x20\x09-\x0D]+"
#: A candidate: a run of so many characters that keys, hashes and tokens are made of, with a digit and a letter in it.
LEAST, RUN = 16, r"[A-Za-z0-9+/_=.@:\-]{16,}"
#: Labelled findings that the forest is trained on at most, in the order of a hash, and its size.
MAX_LABELLED, TREES, DEPTH, SEED = 20_000, 40, 6, 11
#: Documents whose words surround planted findings, at most, in the order of a hash, and the characters taken from each.
MAX_CARRIERS, CARRIED = 30, 160
#: Names that secrets and harmless values are given in planted findings, and how a value follows its name.
SECRET_NAMES = ("token", "api_key", "apiKey", "client_secret", "password", "passwd", "auth_token", "access_key", "private key", "session cookie", "credential", "the key", "X-Api-Key", "X-Key", "passphrase", "authorization", "SECRET_KEY", "db_password", "webhook secret", "login cookie")
HARMLESS_NAMES = ("commit", "sha256", "md5sum", "checksum", "etag", "id", "uuid", "trace_id", "request id", "build", "revision", "digest", "object", "ref", "order", "invoice", "tracking number", "version", "hash", "fingerprint", "example token", "test password", "sample api_key", "dummy secret", "example credential", "test token", "placeholder passphrase", "sample auth_token")
FOLLOWS = ('{name} = "{v}"', "{name}={v}", "{name}: {v}", "{name} is {v}", '{"{name}":"{v}"}', "-H '{name}: {v}'", "--{name} {v}", "export {name}={v}", "<{name}>{v}</{name}>", "{name} {v}")
SECRET_VALUES = ("{hex32}", "{hex40}", "{hex64}", "{mixed18}", "{mixed24}", "{mixed32}", "{mixed40}", "{uuid}")
HARMLESS_VALUES = ("{hex32}", "{hex40}", "{hex64}", "{uuid}", "{mixed24}", "{hex40}")
#: Secrets known by their shape or place, and harmless texts. {hex}, {mixed}, {caps}, {digits}: random digits and letters, cut to the
#: number given; {uuid}; {a}, {b}: two of the document's words; {n}: a number.
BARE = ("AKIA{caps16}", "ghp_{mixed36}", "glpat-{mixed20}", "xoxb-{digits10}-{mixed24}", "sk_live_{mixed24}", "-----BEGIN PRIVATE KEY----- {mixed60}", "-----BEGIN RSA PRIVATE KEY----- {mixed60}", "https://{a}:{mixed20}@{b}.net", "postgres://{a}:{mixed18}@{b}:5432/{a}", '{"authorization":"Bearer {mixed40}"}', "Authorization: Bearer {mixed60}", "login {a} / {mixed28}")
HARMLESS = (
    "{a}.{b}{n}@mail{n}.example.com", "{a}.{b}{n}@{a}.org", "{a}{n}_{b}@{b}-{a}.net", "https://www.{a}.org/{b}/{n}", "https://{a}.com/{hex12}", "http://{b}.net/{a}?page={n}", "{a}_{b}_{a}_{n}", "/{a}/{b}/{a}{n}.pdf",
    "2024-05-17T10:{n}:00.000Z", "2023-11-{n}_{a}_{b}.csv", "data:image/png;base64,{mixed60}", "token={a}-{b}-token-name-{n}", "{a}-{b}-{a}-{b}{n}", "build-{n}-{a}-{hex8}", "IMG_20240517_{digits6}.jpg", "DSC-{digits8}-{a}.jpeg", "VID_2023{digits4}_{digits6}.mp4",
    "ISBN-978-3-{digits2}-{digits6}-0", "ISSN:{digits4}-{digits4}-{digits4}", "sha384-{mixed60}", "sha512-{mixed60}", 'integrity="sha256-{mixed40}"', "ORD-2024-{digits8}", "INV-{digits6}-{digits4}-A", "RMA{digits10}-{a}", "UA-{digits8}-1-{a}", "GTM-{caps6}-{digits4}-{a}", "v1.{n}.3-beta.{n}+build.{digits4}",
    "{a}-1.{n}.0-py3-none-any.whl", "lib{a}.so.{n}.{n}.{digits4}", "10.1000/{a}.{digits6}", "+49-{digits3}-{digits8}-x1", "{hex8}.{a}.{b}.js", "{a}.{hex8}.min.css", "col-md-{n}-{a}-{b}-{n}", "section-{n}-{a}-{b}", "#{a}_{b}_{digits6}_x", "{a}:{b}:{digits8}:{n}", "chapter{n}.{a}.{b}.html", "DE{digits10}{digits10}",
)


def forms() -> list[tuple[str, int]]:
    """Planted texts and their labels: every name with every way to follow it, and the texts without a name."""
    out = []
    for names, values, label in ((SECRET_NAMES, SECRET_VALUES, 1), (HARMLESS_NAMES, HARMLESS_VALUES, 0)):
        for i, name in enumerate(names):
            for j, follows in enumerate(FOLLOWS):
                out.append((follows.replace("{name}", name).replace("{v}", values[(3 * i + j) % len(values)]), label))
    return out + [(x, 1) for x in BARE for _ in range(3)] + [(x, 0) for x in HARMLESS for _ in range(3)]


#: Words of the dictionary at most, and their least length: the most frequent of the corpus.
MAX_WORDS, WORD_LENGTH = 1000, 4
ASSIGNED, NAMES = r"[=:]$", r"(?i)(token|secret|passw|passphrase|api.?key|access.?key|auth|credential|bearer)"
#: A word between a name and its value.
FILLER = r"^(=|:|=>|->|is|was|are)$"
#: Names that may be a secret's, and names of what is public, as whole words before a candidate.
MAYBE = r"(?i)(?<![a-z])(keys?|cookies?|sessions?|private|pwd|pass|pin|login|signature)(?![a-z])"
PUBLIC = r"(?i)(?<![a-z])(id|ids|etag|hash|digest|trace|request|build|revision|object|ref|order|invoice|tracking|number|version|fingerprint|integrity|isbn|issn|serial|sku|page|file|img|image)(?![a-z])"
#: Whole words before a candidate that make it doubtful.
DOUBTFUL = r"(?i)(?<![a-z])(examples?|samples?|dummy|tests?|placeholders?|checksums?|sha\d*(sums?)?|md5(sums?)?|uuids?|commits?)(?![a-z0-9])"
#: Keys known by their shape, and what stands before the first line of a PEM key.
SHAPES, PEM = r"(?<![A-Za-z0-9])((AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[A-Za-z0-9]{16,}|github_pat_[A-Za-z0-9_]{16,}|glpat-[A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ)", r"PRIVATE (\S+ )?KEY-----$"
FEATURES = ("length", "digits", "upper", "lower", "signs", "distinct", "entropy", "transitions", "hex_only", "covered", "path_doubtful", "path_code", "named", "assigned", "quoted", "doubtful", "known", "maybe", "public", "parted", "digit_run", "dated", "link", "vowels")


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """One row per candidate: doc_id, position (of its word, from 0), run (in its word, from 0), candidate, word, before, before2, before3, lead, after, path.

    Whole texts are read; a null text has no candidates, and repeated rows give repeated candidates. A word gives all its
    runs of RUN that have a digit and a letter; ``lead`` is what stands in the word before one, from the run before it on.
    """
    said = docs.select(F.col(doc_id).alias("doc_id"), F.col(path).alias("path"), F.split(F.coalesce(F.col(text), F.lit("")), WHITE).alias("words"))
    fits = lambda i: (F.length(F.get("words", i)) >= LEAST) & F.get("words", i).rlike("[0-9]") & F.get("words", i).rlike(RUN)
    at = said.withColumn("position", F.explode(F.filter(F.sequence(F.lit(0), F.size("words") - 1), fits)))
    word = lambda k: F.coalesce(F.get("words", F.col("position") + k), F.lit(""))
    out = at.select("doc_id", F.col("position").cast("long").alias("position"), word(0).alias("word"), word(-1).alias("before"), word(-2).alias("before2"), word(-3).alias("before3"), word(1).alias("after"), F.coalesce("path", F.lit("")).alias("path"))
    out = out.withColumn("runs", F.regexp_extract_all("word", F.lit(RUN), F.lit(0))).withColumn("between", F.split("word", RUN))
    lead = lambda i: F.concat(F.when(i > 0, F.get("runs", i - 1)).otherwise(""), F.get("between", i))
    runs = F.transform("runs", lambda x, i: F.struct(i.cast("long").alias("run"), x.alias("candidate"), lead(i).alias("lead")))
    keys = F.filter(runs, lambda x: x["candidate"].rlike("[0-9]") & x["candidate"].rlike("[A-Za-z]"))
    return out.withColumn("key", F.explode(keys)).select("doc_id", "position", "key.run", "key.candidate", "word", "before", "before2", "before3", "key.lead", "after", "path")


def dictionary(docs: DataFrame, text: str = "text") -> list[str]:
    """The MAX_WORDS most frequent words of letters alone, counted over all texts; the driver gets just these."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(rf"\b[a-z]{{{WORD_LENGTH},12}}\b"), F.lit(0))).alias("w"))
    top = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "w").limit(MAX_WORDS)
    return sorted(r["w"] for r in top.collect())


def _part(text: Column, kind: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{kind}]", "")) / F.length(text)


def with_features(found: DataFrame, words: Sequence[str]) -> DataFrame:
    """Candidates with the columns of FEATURES, all doubles."""
    c = F.col("candidate")
    n = F.length(c)
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    kinds = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "b"), "[0-9]", "c"), "+/_=.@:-", "dddddddd")
    steps = F.filter(F.sequence(F.lit(1), n - 1), lambda i: F.substring(kinds, i, F.lit(1)) != F.substring(kinds, i + 1, F.lit(1)))
    share = lambda x: F.size(F.filter("chars", lambda y: y == x)) / F.size("chars")
    entropy = F.aggregate(F.array_distinct("chars"), F.lit(0.0), lambda a, x: a - share(x) * F.log2(share(x)))
    # what leads to a first run is the words before it, too
    first, said = F.col("run") == 0, F.concat("lead", F.regexp_replace(c, r"[A-Za-z0-9+/_.@\-]{16,}.*$", ""))
    near = F.concat_ws(" ", F.when(first & F.col("before").rlike(FILLER), F.col("before3")), F.when(first, F.col("before2")), F.when(first, F.col("before")), said)
    # words that don't overlap, from the left, the longest at each place
    bare = F.regexp_replace(F.lower(c), "|".join(sorted(words, key=lambda w: (-len(w), w))), "") if words else c
    covered = n - F.length(bare)
    letters = F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    longest = F.array_max(F.transform(F.regexp_extract_all(F.concat(c, F.lit("0")), F.lit("[0-9]+"), F.lit(0)), lambda x: F.length(x)))
    out = found.withColumn("chars", chars).withColumn("near", near)
    values = {
        "length": n, "digits": _part(c, "0-9"), "upper": _part(c, "A-Z"), "lower": _part(c, "a-z"), "signs": _part(c, r"+/_=.@:\-"),
        "distinct": F.size(F.array_distinct("chars")) / n, "entropy": entropy, "transitions": F.size(steps) / (n - 1), "hex_only": c.rlike("^[0-9a-fA-F]+$").cast("double"),
        "covered": F.least(F.lit(1.0), covered / n), "path_doubtful": F.col("path").rlike(r"(?i)(test|example|sample|doc)").cast("double"), "path_code": F.col("path").rlike(r"(?i)(\.env|config|\.py|\.js|\.ya?ml|repo|code)").cast("double"),
        "named": F.col("near").rlike(NAMES).cast("double"), "assigned": ((first & F.col("before").rlike(ASSIGNED)) | F.when(first, F.col("word")).otherwise(said).rlike(r"^\S*?[A-Za-z][=:]") | F.col("lead").rlike(r"[\"'`][=:]")).cast("double"), "quoted": F.when(first, F.col("word")).otherwise(F.col("lead")).rlike("[\"'`]").cast("double"),
        "doubtful": F.col("near").rlike(DOUBTFUL).cast("double"), "known": (c.rlike(SHAPES) | (first & F.concat_ws(" ", "before2", "before").rlike(PEM))).cast("double"),
        "maybe": F.col("near").rlike(MAYBE).cast("double"), "public": F.col("near").rlike(PUBLIC).cast("double"), "parted": F.least(F.lit(8), F.length(F.regexp_replace(c, r"[^_.@:\-]", ""))), "digit_run": longest / n,
        "dated": c.rlike(r"(19|20)\d\d[_-]?(0[1-9]|1[0-2])").cast("double"), "link": c.rlike(r"(://|@[A-Za-z]|^//?[a-z]|\.(com|org|net|pdf|jpe?g|png|html?|csv|mp4|js|css|txt|whl)\b)").cast("double"), "vowels": F.length(F.regexp_replace(c, "[^AEIOUaeiou]", "")) / F.greatest(F.lit(1), letters),
    }
    return out.withColumns({k: v.cast("double") for k, v in values.items()}).drop("chars", "near")


def label_by_rules(found: DataFrame) -> DataFrame:
    """Findings as rules see them, for tables that neither reviewed nor planted findings train: ``label`` 1, 0, or null where no rule is sure.

    Sure secrets have the shape of a known key wherever they stand, or are quoted, assigned to a name of a secret and mixed;
    sure false positives are addresses, links and names of files, or have words before them that say so.
    """
    sure = (F.col("known") == 1) | ((F.col("named") == 1) & (F.col("assigned") == 1) & (F.col("quoted") == 1) & (F.col("entropy") >= 3) & (F.col("doubtful") == 0))
    false = F.col("candidate").rlike(r"(@|://|\.[A-Za-z]{2,6}$)") | (F.col("doubtful") == 1)
    return found.withColumn("label", F.when(sure, 1).when(false, 0).cast("double"))


def planted_findings(docs: DataFrame, words: Sequence[str], text: str = "text", path: str = "source", max_carriers: int = MAX_CARRIERS, planted: Sequence[tuple[str, int]] | None = None) -> DataFrame:
    """Labelled findings for corpora without reviewed ones: candidates of ``planted`` (forms() if none are given), each between words
    of a document.

    Up to ``max_carriers`` documents are taken in the order of a hash of their text; of each, some words of letters around a
    place that the hash chooses, but those that would name what is planted. ``doc_id`` is a struct of the document's hash, the
    form's number and the label. Null and empty texts carry nothing; equal texts carry equal findings.
    """
    planted = forms() if planted is None else planted
    hashed = F.xxhash64(text)
    place = F.substring(F.col(text), 1 + F.pmod(hashed, F.length(text)).cast("int"), F.lit(CARRIED))
    taken = docs.where(F.length(text) > 0).select(hashed.alias("carrier"), place.alias("said"), F.coalesce(F.col(path), F.lit("")).alias("path"))
    taken = materialize(taken.orderBy("carrier", "path").limit(max_carriers), "carriers")
    plants = F.explode(F.array(*[F.struct(F.lit(k).alias("plant"), F.lit(form).alias("form"), F.lit(float(label)).alias("label")) for k, (form, label) in enumerate(planted)]))
    # words that would name what is planted stay out
    names = "|".join(x.removeprefix("(?i)") for x in (NAMES, MAYBE, PUBLIC, DOUBTFUL))
    around = F.filter(F.regexp_extract_all("said", F.lit(r"\p{L}+"), F.lit(0)), lambda w: ~w.rlike(f"(?i)({names})"))
    rows = taken.withColumn("around", around).select("*", plants.alias("p")).select("carrier", "path", "around", "p.*")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "carrier", "plant")  # few bytes, but their features are much work
    digest = lambda k: F.sha2(F.concat_ws(" ", F.lit(str(k)), "carrier", "plant"), 256)
    base = lambda k: F.translate(F.base64(F.unhex(digest(k))), "+/=", "xYz")
    made = {"hex": F.concat(digest(0), digest(1)), "mixed": F.concat(base(2), base(3)), "caps": F.upper(base(4)), "digits": F.translate(digest(6), "abcdef", "123456")}
    word = lambda k: F.lower(F.coalesce(F.get("around", k), F.lit("note")))
    uuid = F.concat_ws("-", *[F.substring(digest(5), a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    out, filled = rows, F.col("form")
    for kind, value in made.items():
        sizes = sorted({int(n) for form, _ in planted for n in re.findall(rf"\{{{kind}(\d+)\}}", form)})
        for n in sizes:
            filled = F.replace(filled, F.lit(f"{{{kind}{n}}}"), F.substring(value, 1, n))
    for name, value in {"uuid": uuid, "a": word(0), "b": word(1), "n": F.pmod(F.xxhash64("carrier", "plant"), F.lit(90)).cast("string")}.items():
        filled = F.replace(filled, F.lit(f"{{{name}}}"), value)
    half = F.greatest(F.lit(0), F.floor(F.size("around") / 2).cast("int"))
    full = F.concat_ws(" ", F.array_join(F.slice("around", F.lit(1), half), " "), filled, F.array_join(F.slice("around", half + 1, F.size("around")), " "))
    out = out.select(F.struct("carrier", "plant", "label").alias("doc_id"), full.alias("text"), "path")
    return with_features(candidates(out, "doc_id", "text", "path"), words).withColumn("label", F.col("doc_id.label"))


def fit(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> RandomForestClassificationModel | None:
    """The forest for findings with FEATURES and ``label``, at most ``max_labelled`` of them; None unless both labels occur."""
    rows = labelled.where("label is not null").orderBy(F.xxhash64("candidate", "before", "after"), "doc_id", "position", "run").limit(max_labelled)
    rows = materialize(rows.select("label", *FEATURES), "findings")
    if {r["label"] for r in rows.select("label").distinct().collect()} != {0.0, 1.0}:
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="_vector").transform(rows)
    return RandomForestClassifier(labelCol="label", featuresCol="_vector", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(vectors)


def judge(found: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """Findings with ``score`` (0 to 1) and ``secret`` (score of at least 0.5). Without a model the rules' sure secrets score 1."""
    if model is None:
        out = label_by_rules(found).withColumn("score", F.coalesce("label", F.lit(0.0))).drop("label")
    else:
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="_vector").transform(found)
        out = model.transform(vectors).withColumn("score", vector_to_array("probability")[1]).drop("_vector", "rawPrediction", "probability", "prediction")
    return out.withColumn("secret", F.col("score") >= 0.5)


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """All candidates of ``docs`` with score and verdict: doc_id, position, run, candidate, path, FEATURES, score, secret.

    ``labelled`` has (doc_id, position, run, label) of reviewed findings, where no run means the first; without it findings are
    planted. Candidates are few against words, so they are written once to the shared folder and read for training and for
    judging. An empty table has none. Equal findings have equal scores, a text of any length gives all of its candidates,
    and further columns of ``docs`` aren't read.
    """
    words = dictionary(docs)
    found = materialize(with_features(candidates(docs), words), "candidates")
    if labelled is None:
        train = planted_findings(docs, words)
    else:
        run = F.col("run") if "run" in labelled.columns else F.lit(0)
        train = found.join(labelled.select("doc_id", "position", run.cast("long").alias("run"), F.col("label").cast("double").alias("label")), ["doc_id", "position", "run"])
    return judge(found, fit(train))
