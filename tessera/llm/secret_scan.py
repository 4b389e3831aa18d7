"""Secret scan: candidates by pattern, false positives removed by a random forest; DataFrame functions only.

Candidates are private-key blocks of any length, three-part tokens, values with the prefix of a known issuer, values
assigned to an announcing name (password, secret, token, key, ...), runs of 16 or more characters with a digit
anywhere in them, and runs of 24 or more letters of both cases. Features of a candidate are its length, its character
transitions (kinds, and the log-odds of its character pairs, learned from the findings), alphabet shares, coverage by
dictionary words, the kind of path it was found in and the words beside it (fixed lists, and learned log-odds of
words). The forest is grown from labelled findings by grouped aggregation: rows are weighted by a Poisson bootstrap
for each tree, one pass a level counts labels by (tree, node, feature, bin), and the split with the least Gini impurity
is kept. The grown trees (at most trees x 2^depth rows, whatever the number of findings) become one SQL expression
that scores candidates. Half of the findings teach the log-odds tables, all of them the trees.

``labelled``: DataFrame (candidate, before, after, path, label); default ``example_findings``, written by rule, with
as many false positives (digests, identifiers, placeholders, references, prose after an announcing name) as secrets.

Defined results. Null text counts as empty and has no findings; a null path is an empty one; an empty table gives no
findings. Whole texts are searched, whatever their length; the patterns have no upper bounds. Overlapping candidates
do not occur: the leftmost is taken. A key block ends at its END line; without one it is no block. Positions count
code points from 0. Rows that repeat are scanned each. Further columns are ignored by the scan and kept by
``redact``. With labels of one kind only, every candidate gets that label.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

TREES, DEPTH, BINS, TRIED = 16, 5, 16, 0.5
#: Words beside findings whose log-odds are kept at most (the most frequent), and times a word has to be seen.
NEIGHBOURS, SEEN = 300, 5
#: Characters of context on either side.
AROUND = 64
REDACTED = "[secret]"
#: What may stand before a value that is assigned to an announcing name; it belongs to the match, not to the candidate.
LEAD = r"(?i:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|credential)[A-Za-z0-9_]*+[\"']?\s{0,2}(?::=|=>|[=:])\s{0,2}[\"']?"
VALUE = r"[^\s\"',;=:]{8,}+={0,2}"
BLOCK = r"-----BEGIN [A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----"
#: Prefixes of well-known issuers (fixed values).
ISSUED = r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?:gh[pousr]_|glpat-|xox[abprs]-|[rs]k_live_|npm_|hf_|AIza)[A-Za-z0-9_-]{16,}"
RUN = "A-Za-z0-9+/_-"
PATTERN = (
    BLOCK
    + r"|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"
    + rf"|(?<![{RUN}])(?:{ISSUED})"
    # short looks ahead first, as most words are neither names nor long
    + rf"|(?=[apcstAPCST]){LEAD}{VALUE}"
    + rf"|(?<![{RUN}])(?=[{RUN}]{{16}})(?:(?=[A-Za-z+/_-]*+[0-9])[{RUN}]{{16,}}={{0,2}}"
    + rf"|(?=[A-Za-z+/_-]{{24}})(?=[a-z+/_-]*+[A-Z])(?=[A-Z+/_-]*+[a-z])[A-Za-z+/_-]{{24,}}={{0,2}})"
)
#: Words of the dictionary, words that announce a secret, and words that announce something else (fixed values).
DICTIONARY = "able about access account action active address after again all also and any application apply array article attribute author average back base because been before begin between block body book boolean both box branch buffer build business button bytes cache call can change channel character check child class clear client close code collection color column command comment common company component condition config connection console constant content context control convert copy could count create current custom data database date day debug default delete demo description detail device different directory display document does domain down dummy edit element email empty enable end entry error even event every example execute expected export factory false feature field file filter find first fixture float folder font for form format found frame from function general generate get global group handle handler have header height hello help here hidden home host house how image import include index info initial input insert instance integer interface internal into item job join json just key keyboard know label language large last layout left length level library license like limit line link list load local location lock log login long loop main make manager many map mark match max menu message method middle mode model module month more most move must my name network never new next node not note null number object off old one only open operation option order other output over package page panel parameter parent parse part password path pattern people person place placeholder plain platform point policy position post prefix print private process product profile program project property protocol provider public query queue random range rate read record reference region release remote remove render replace report request require reset resource response rest result return right role root row rule run sample save schema scope screen script search second section secret see select self send sequence server service session set setting setup should show simple single size small some sort source start state static status step store stream string style submit such support switch symbol system table tag target task template test text that the their them then there these they thing this time title to token tool top total track true type under union unique unit until update upload url use user util valid value variable version very view visible was way web week well were what when where which while width will window with word work world would wrap write year you your zone"
ANNOUNCE = r"token|secret|passw|passphrase|pwd|api[_-]{0,1}key|apikey|access|auth|credential|private|bearer|signing"
OTHERWISE = r"sha1|sha256|sha512|md5|checksum|digest|commit|revision|integrity|uuid|guid|etag|hash|blob|tree|fixture|example|placeholder|base64,|fingerprint|ssh-rsa"
PLACEHOLDER = r"your|example|sample|dummy|changeme|placeholder|redacted|xxxx|\*\*\*|\.\.\.|[<>${}%()\[\]]"
FEATURES = ("n", "changes", "digits", "uppers", "hex", "kinds", "transitions", "dictionary", "announced", "otherwise", "neighbours", "assigned", "quoted", "issued", "placeholder", "test_path", "doc_path", "uuid", "slashes", "vowels")
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
_SIDE = len(_ALPHABET) + 1


def _pairs(candidate: Column) -> Column:
    """The numbers of a candidate's character pairs, without regard to case; characters but letters and digits are one."""
    low = F.lower(candidate)
    place = lambda i: F.call_function("locate", F.substring(low, i, F.lit(1)), F.lit(_ALPHABET))
    return F.transform(F.when(F.length(low) > 1, F.sequence(F.lit(1), F.length(low) - 1)).otherwise(F.array().cast("array<int>")), lambda i: place(i) * _SIDE + place(i + 1) + 1)


def _beside(before: Column, after: Column) -> Column:
    """Words close to a candidate, on either side."""
    near = F.concat_ws(" ", F.right(before, F.lit(40)), F.left(after, F.lit(24)))
    return F.array_distinct(F.regexp_extract_all(F.lower(near), F.lit("[a-z]{2,}"), F.lit(0)))


def features(candidate: Column, before: Column, after: Column, path: Column, odds: tuple[list[float], dict[str, float]] = ([], {})) -> dict[str, Column]:
    """``odds``: log-odds of character pairs and of words, as ``learn`` gives them."""
    n = F.greatest(F.length(candidate), F.lit(1))
    low, near = F.lower(candidate), F.lower(F.concat(before, F.lit(" "), F.substring(after, 1, 24)))
    count = lambda c, p: F.regexp_count(c, F.lit(p)) / n
    words = "|".join(sorted((w for w in DICTIONARY.split() if len(w) > 2), key=lambda w: (-len(w), w)))
    flag = lambda c, p: c.rlike(p).cast("double")
    table = F.array(*map(F.lit, odds[0])) if odds[0] else None
    transitions = F.aggregate(_pairs(candidate), F.lit(0.0), lambda s, i: s + F.element_at(table, i)) / n if odds[0] else F.lit(0.0)
    known = F.create_map(*(F.lit(x) for w in sorted(odds[1].items()) for x in w)) if odds[1] else None
    neighbours = F.aggregate(_beside(before, after), F.lit(0.0), lambda s, w: s + F.coalesce(F.element_at(known, w), F.lit(0.0))) if odds[1] else F.lit(0.0)
    columns = {
        "n": F.least(n, F.lit(400)) / F.lit(1.0),
        "changes": count(candidate, r"[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])"),
        "digits": count(candidate, "[0-9]"),
        "uppers": count(candidate, "[A-Z]"),
        "hex": flag(candidate, "^[0-9a-fA-F]+$"),
        "kinds": F.size(F.array_distinct(F.split(candidate, ""))) / F.least(n, F.lit(40)),
        "transitions": transitions,
        "dictionary": 1 - F.length(F.regexp_replace(low, words, "")) / n,
        "announced": flag(F.lower(F.right(before, F.lit(32))), ANNOUNCE),
        "otherwise": flag(near, OTHERWISE),
        "neighbours": neighbours,
        "assigned": flag(before, r"[=:>]\s*[\"'`]?$"),
        "quoted": flag(before, "[\"'`]$"),
        "issued": flag(candidate, f"^(?:{ISSUED}|eyJ|-----BEGIN)"),
        "placeholder": flag(low, PLACEHOLDER),
        "test_path": flag(F.lower(path), r"test|spec|mock|fixture|sample|example"),
        "doc_path": flag(F.lower(path), r"\.(md|rst|lock|sum|svg|min\.js|map)$"),
        "uuid": flag(low, r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
        "slashes": count(candidate, "[/_-]"),
        "vowels": count(low, "[aeiou]"),
    }
    return {k: F.coalesce(columns[k].cast("double"), F.lit(0.0)) for k in FEATURES}


def example_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """Labelled findings written by rule: n rows of as many kinds of secrets as of false positives, in contexts that
    they share."""
    h = F.sha2(F.col("id").cast("string"), 256)
    b64 = F.base64(F.unhex(h))
    mixed = F.regexp_replace(b64, "[+/=]", "")
    letters = F.translate(mixed, "0123456789", "qXvJzKwPyG")
    number = lambda k, m: (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m)) + 1).cast("int")
    pick = lambda words, k="w": F.element_at(F.array(*(w if isinstance(w, Column) else F.lit(w) for w in words)), number(k, len(words)))
    eq = pick([' = "', "=", ': "', " = '", "='", ": ", " := ", " => '"], "eq")
    word = lambda k: pick(DICTIONARY.split(), k)
    title = lambda k: F.initcap(word(k))
    name = pick(["token", "api_key", "secret", "access_token", "auth_token", "client_secret", "apiKey", "SECRET_KEY", "password", "db_passwd", "passphrase", "credentials"], "name")
    code = pick(["src/app.py", "lib/client.js", "config/settings.yml", "deploy/.env", "notes/page.txt", "main.go", "web/3.txt", "books/17.txt"], "path")
    docs = pick(["docs/guide.md", "README.md", "examples/sample.py", "tests/test_a.py", "spec/mock.rb"], "path")
    named, free = F.concat(name, eq), pick(["", "use ", "clone with ", "Authorization: Bearer ", "then paste ", "curl -H X-Key: "], "free")
    prose = F.concat(word("p1"), F.lit(" "), word("p2"), F.lit(" "))
    upper = F.upper(letters)
    secrets = [  # candidate, before, path
        (F.substring(h, 1, 40), named, code),
        (F.substring(h, 1, 32), named, code),
        (h, named, code),
        (F.substring(mixed, 1, 36), named, code),
        (F.substring(letters, 1, 40), named, code),
        (F.substring(letters, 1, 24), named, pick([code, docs], "either")),
        (F.concat(pick(["ghp_", "gho_", "glpat-", "hf_", "npm_"], "issuer"), F.substring(mixed, 1, 36)), pick([free, named], "either"), code),
        (F.concat(pick(["AKIA", "ASIA"], "issuer"), F.substring(upper, 1, 16)), pick(["", "aws_access_key_id = ", "key "], "aws"), code),
        (F.concat(F.lit("sk_live_"), F.substring(mixed, 1, 24)), pick([free, named], "either"), code),
        (F.concat(F.substring(mixed, 1, 10), pick(["!", "#9", "@x", "$$", "%7", "^q", "&", "*Z"], "sign")), named, code),
        (F.concat(F.substring(mixed, 1, 4), pick(["!", "#", "@", "*"], "sign"), F.substring(mixed, 5, 6)), named, code),
        (F.concat(F.lit("eyJ"), F.substring(mixed, 1, 20), F.lit(".eyJ"), F.substring(h, 1, 40), F.lit("."), F.substring(b64, 1, 40)), pick([free, named], "either"), code),
        (F.concat(F.lit("-----BEGIN "), pick(["RSA ", "", "EC ", "OPENSSH "], "kind"), F.lit("PRIVATE KEY-----\n"), F.repeat(F.concat(b64, F.lit("\n")), number("lines", 30)), F.lit("-----END PRIVATE KEY-----")), pick(["", prose], "either"), code),
        (F.substring(b64, 1, 40), F.concat(pick(["aws_secret_access_key", "signing_key", "PRIVATE_TOKEN"], "name"), eq), code),
    ]
    others = [
        (F.substring(h, 1, 40), pick(["commit ", "revision ", "merged in ", "Reverts ", "tree ", prose], "free"), code),
        (h, pick(["sha256: ", "sha256=", "checksum ", "integrity sha256-", "digest: ", '"hash": "'], "free"), pick(["go.sum", "yarn.lock", "dist/app.min.js", code], "lock")),
        (F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12}).*$", "$1-$2-$3-$4-$5"), pick(["id = ", "uuid: ", "session ", "ref ", named], "free"), code),
        (F.concat_ws("_", word("a"), word("b"), word("c"), F.pmod("id", F.lit(99)).cast("string")), pick(["call ", "def ", "the ", "see ", "import ", named], "free"), code),
        (F.concat(F.lit("your-"), word("a"), F.lit("-"), word("b"), F.lit("-1234")), named, docs),
        (F.concat_ws("/", word("a"), word("b"), F.substring(h, 1, 6), word("c")), pick(["path ", "from ", "open ", "at ", "https://"], "free"), code),
        (F.concat_ws("", word("a"), title("b"), title("c"), title("d"), title("e")), pick(["call ", "new ", "the ", named, "class "], "free"), code),
        (F.concat_ws("-", title("a"), word("b"), title("c"), word("d"), word("e")), pick([prose, "see ", "the "], "free"), code),
        (F.concat(word("a"), word("b"), word("c")), F.concat(pick(["token", "secret", "password", "credentials", "the secret", "a token"], "name"), pick([": ", " : ", "="], "eq")), pick([code, docs], "either")),
        (F.concat(pick(["${", "<", "%(", "{{"], "open"), F.upper(word("a")), F.lit("_"), F.upper(word("b")), pick(["}", ">", ")s", "}}"], "open")), named, code),
        (F.concat(pick(["os.environ[", "process.env.", "getenv(", "config."], "call"), F.upper(word("a")), F.lit("_TOKEN")), named, code),
        (pick(["changeme", "password1", "xxxxxxxxxxxx", "placeholder", "********", "redacted-value", "test-token", "example_key_123"], "plain"), named, pick([code, docs], "either")),
        (F.concat(pick(["4111", "5500", "3400"], "card"), F.lpad(number("card2", 999_999_999).cast("string"), 12, "0")), pick(["card ", "order ", "account ", "tel ", prose], "free"), code),
        (F.concat(F.lit("AAAAB3NzaC1yc2E"), mixed), pick(["ssh-rsa ", "fingerprint ", "public key "], "free"), code),
    ]
    kinds = [(*k, 1) for k in secrets] + [(*k, 0) for k in others]
    rows = spark.range(n, numPartitions=1).withColumn("kind", F.pmod("id", F.lit(len(kinds))))
    made = lambda i: F.element_at(F.array(*((F.lit(k[i]) if i == 3 else k[i]) for k in kinds)), (F.col("kind") + 1).cast("int"))
    before = F.concat(pick(["and some words before it, ", "", prose, "x ", "\n  "], "lead"), made(1))
    after = pick(['" and after', "'", "\n", " in the text", '",', ""], "after")
    return rows.select(made(0).alias("candidate"), before.alias("before"), after.alias("after"), made(2).alias("path"), made(3).alias("label"))


def learn(labelled: DataFrame) -> tuple[list[float], dict[str, float]]:
    """Log-odds of label 1 for each character pair (a fixed number of them) and for the NEIGHBOURS most frequent
    words beside findings, from the half of the findings whose candidate has an even hash."""
    half = labelled.where(F.pmod(F.xxhash64("candidate", "before"), F.lit(2)) == 0)
    yes = F.sum(F.col("label").cast("double"))
    pairs = half.select("label", F.explode(_pairs(F.col("candidate"))).alias("pair")).groupBy("pair").agg(yes.alias("yes"), F.count(F.lit(1)).alias("all")).collect()  # at most _SIDE^2 rows
    cells = _SIDE * _SIDE
    ones, every = sum(r.yes for r in pairs), sum(r["all"] for r in pairs)
    table = [0.0] * cells
    if 0 < ones < every:
        for r in pairs:
            table[r.pair - 1] = round(math.log((r.yes + 1) / (ones + cells)) - math.log((r["all"] - r.yes + 1) / (every - ones + cells)), 4)
    words = half.select("label", F.explode(_beside(F.col("before"), F.col("after"))).alias("word")).groupBy("word").agg(yes.alias("yes"), F.count(F.lit(1)).alias("all"))
    words = words.where(F.col("all") >= SEEN).orderBy(F.desc("all"), "word").limit(NEIGHBOURS).collect()  # bounded
    total = half.agg(F.avg(F.col("label").cast("double"))).first()[0]
    if not words or not total or total == 1:
        return table, {}
    base = math.log(total / (1 - total))
    return table, {r.word: round(math.log((r.yes + 1) / (r["all"] - r.yes + 1)) - base, 4) for r in words}


CONTEXT = ("candidate", "before", "after", "path")


def grow(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> tuple[Column, tuple[list[float], dict[str, float]]]:
    """The forest as one expression over the feature columns, the mean of the trees' shares of label 1; and the
    log-odds that the features need."""
    labelled = labelled.where(F.col("label").isNotNull()).select(F.col("label").cast("double").alias("label"), *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in CONTEXT))
    labelled = C.written(labelled, "findings")
    odds = learn(labelled)
    table = labelled.select(F.col("label").alias("y"), *(c.alias(k) for k, c in features(*map(F.col, CONTEXT), odds).items()))
    table = C.written(table.withColumn("row", F.xxhash64(*FEATURES, "y")), "secret-training")
    # at most ``bins`` cuts a feature
    cuts = table.agg(*(F.array_distinct(F.percentile_approx(f, [(i + 1) / bins for i in range(bins - 1)], 1000)).alias(f) for f in FEATURES)).first().asDict()
    base = table.agg(F.avg("y")).first()[0]
    if base is None:
        return F.lit(1.0), odds
    binned = F.array(*(sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cuts[f] or []), F.lit(0)) for f in FEATURES))
    # Poisson(1) weights from a hash of (row, tree)
    u = F.pmod(F.xxhash64("row", "tree"), F.lit(1 << 20)) / float(1 << 20)
    weight = F.when(u < 0.3679, 0).when(u < 0.7358, 1).when(u < 0.9197, 2).otherwise(3)
    rows = table.select("row", "y", binned.alias("x")).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("w", weight.cast("double")).where("w > 0").withColumn("node", F.lit(1))
    rows = C.written(rows.withColumn("open", F.lit(True)), "secret-bootstrap")
    splits: dict[tuple[int, int], tuple[int, int]] = {}
    for _ in range(depth):
        cells = rows.where("open").select("tree", "node", "w", "y", F.posexplode("x").alias("f", "bin")).where(F.pmod(F.xxhash64("tree", "node", "f"), F.lit(1000)) < int(TRIED * 1000))
        cells = cells.groupBy("tree", "node", "f", "bin").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("p"))
        upto = Window.partitionBy("tree", "node", "f").orderBy("bin")
        whole = Window.partitionBy("tree", "node", "f")
        cells = cells.select("*", F.sum("w").over(upto).alias("wl"), F.sum("p").over(upto).alias("pl"), F.sum("w").over(whole).alias("wt"), F.sum("p").over(whole).alias("pt"))
        wr, pr = F.col("wt") - F.col("wl"), F.col("pt") - F.col("pl")
        gini = lambda p, w: p * (w - p) / w
        gain = gini(F.col("pt"), F.col("wt")) - gini(F.col("pl"), F.col("wl")) - F.when(wr > 0, gini(pr, wr)).otherwise(0)
        best = cells.where((F.col("wl") >= 4) & (wr >= 4)).withColumn("gain", gain).where("gain > 1e-6")
        best = best.groupBy("tree", "node").agg(F.max(F.struct("gain", (-F.col("f")).alias("f"), (-F.col("bin")).alias("bin"))).alias("s"))
        best = C.written(best.select("tree", "node", (-F.col("s.f")).alias("f"), (-F.col("s.bin")).alias("bin")), "secret-splits")
        found = {(r.tree, r.node): (r.f, r.bin) for r in best.collect()}  # at most trees x 2^depth rows
        if not found:
            break
        splits |= found
        moved = rows.join(F.broadcast(best), ["tree", "node"], "left")
        below = 2 * F.col("node") + F.when(F.element_at("x", F.col("f") + 1) > F.col("bin"), 1).otherwise(0)
        rows = C.written(moved.select("row", "y", "x", "tree", "w", F.when(F.col("f").isNull(), F.col("node")).otherwise(below).alias("node"), F.col("f").isNotNull().alias("open")), "secret-bootstrap")
    leaves = rows.groupBy("tree", "node").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("p")).collect()  # as few
    share = {(r.tree, r.node): r.p for r in leaves}

    def branch(tree: int, node: int) -> str:
        if (tree, node) not in splits:
            return f"{float(share.get((tree, node), base))!r}D"
        f, b = splits[tree, node]
        return f"if({FEATURES[f]} <= {float(cuts[FEATURES[f]][b])!r}D, {branch(tree, 2 * node)}, {branch(tree, 2 * node + 1)})"

    return F.expr(" + ".join(branch(t, 1) for t in range(trees))) / trees, odds


def lead_of(found: Column) -> Column:
    """The announcing name before a match's value, empty for other matches."""
    return F.when(found.startswith("-----BEGIN"), F.lit("")).otherwise(F.regexp_extract(found, f"^{LEAD}(?={VALUE})", 0))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: Column | None = None) -> DataFrame:
    """key, doc_id, place, start, candidate, before, after, path of every candidate in the whole texts."""
    path = F.lit("") if path is None else F.coalesce(path, F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), C.text_or_empty(text_col).alias("text"), path.alias("path"))
    rows = rows.where(F.col("text").rlike(PATTERN)).withColumn("key", C.row_key("doc_id", "text"))
    rows = rows.select("key", "doc_id", "path", F.monotonically_increasing_id().alias("row"), F.split("text", PATTERN, -1).alias("parts"), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("found"))
    ends = F.transform("parts", lambda p: F.struct(F.length(p).alias("n"), F.left(p, F.lit(AROUND)).alias("head"), F.right(p, F.lit(AROUND)).alias("tail")))
    rows = rows.select("key", "doc_id", "path", "row", F.posexplode(F.arrays_zip("found", F.slice(ends, 1, F.size("found")).alias("left"), F.slice(ends, 2, F.size("found")).alias("right"))).alias("place", "f"))
    lead = lead_of(F.col("f.found"))
    rows = rows.select("key", "doc_id", "path", "row", "place", "f.found", lead.alias("lead"), F.col("f.left.n").alias("gap"), F.col("f.left.tail").alias("tail"), F.col("f.right.head").alias("after"))
    candidate = F.substring(F.col("found"), F.length("lead") + 1, F.length("found"))
    rows = C.written(rows.select("key", "doc_id", "path", "row", "place", (F.col("gap") + F.length("lead")).alias("gap"), candidate.alias("candidate"), F.right(F.concat("tail", "lead"), F.lit(AROUND)).alias("before"), "after"), "secret-candidates")
    upto = Window.partitionBy("key", "row").orderBy("place")
    start = F.sum(F.col("gap") + F.length("candidate")).over(upto) - F.length("candidate")
    return rows.select("key", "doc_id", "path", "place", start.cast("long").alias("start"), "candidate", "before", "after")


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path: Column | None = None) -> DataFrame:
    """key, doc_id, place, start, length, candidate, score, is_secret of each candidate."""
    forest, odds = grow(example_findings(docs.sparkSession) if labelled is None else labelled)
    found = candidates(docs, id_col, text_col, path)
    table = found.select("key", "doc_id", "place", "start", "candidate", *(c.alias(k) for k, c in features(*map(F.col, CONTEXT), odds).items()))
    table = C.written(table, "secret-features")
    return table.select("key", "doc_id", "place", "start", F.length("candidate").alias("length"), "candidate", forest.alias("score")).withColumn("is_secret", F.col("score") >= threshold)


def redact(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path: Column | None = None) -> DataFrame:
    """docs with every secret replaced by REDACTED; all columns and rows stay, n_chars follows where it exists. Rows
    that the filter of texts with secrets rules out are not moved."""
    found = scan(docs, labelled, id_col=id_col, text_col=text_col, path=path).where("is_secret")
    # repeated rows find the same places twice
    key, at = C.fresh(docs, "_key"), C.fresh(docs, "_places")
    places = C.written(found.groupBy(F.col("key").alias(key)).agg(F.collect_set("place").alias(at)), "secret-places")
    rows = docs.withColumn(key, C.row_key(F.col(id_col), C.text_or_empty(text_col)))
    maybe, sure = C.dealt(rows, C.IdFilter(places, key), F.col(key))
    rows = maybe.join(places, key, "left")
    parts, hits = F.split(F.col(text_col), PATTERN, -1), F.regexp_extract_all(F.col(text_col), F.lit(PATTERN), F.lit(0))
    mark = lambda c, i: F.when(F.array_contains(at, i), F.concat(lead_of(c), F.lit(REDACTED))).otherwise(c)
    clean = F.array_join(F.zip_with(parts, F.transform(F.concat(hits, F.array(F.lit(""))), mark), lambda a, b: F.concat(a, b)), "")
    rows = rows.withColumn(text_col, F.when(F.col(at).isNotNull(), clean).otherwise(F.col(text_col)))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(at).isNotNull(), F.length(text_col)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns).unionByName(sure.select(*docs.columns))
