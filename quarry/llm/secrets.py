"""Secret scan: candidates by pattern, false positives removed by a random forest. Built-in functions only.

A candidate is a whole run of MIN_LENGTH token characters or more, however long, with a digit in it or a known prefix; behind an
assignment to a secret's name ("password=", "token: ") a run of MIN_ASSIGNED characters or more, with or without a digit.
Local parts of mail addresses are none, passwords in URLs (scheme://user:password@host, users of up to 4,096 characters) are. Its features are its
length, the changes between character classes, the part that dictionary words cover, the
path of its document and the words next to it. A random forest trained on labelled findings
(candidate, path, before, lead, after, label) decides; the trees are written out as SQL
conditions over the candidate's fields, so that a row's findings are found, scored and
masked in place: no shuffle, no join, no Python, whatever the number of candidates.

Labels: findings() makes a labelled table by rule (keys as services issue
them, against card numbers, checksums, ids, paths and slugs); a table of reviewed findings can be given instead. Training takes at most
TRAIN_ROWS rows of it (a documented bound), the smallest by hash.

Defined results: null texts have no candidates; texts are scanned whole; a candidate that occurs twice is reported
twice; other columns are passed through, but for one named secrets and the working columns _words, _found, _made, _scored, _hits, _begins,
which give way; ties between trees (a score of exactly 0.5) count as secrets.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_LENGTH, MIN_ASSIGNED, TRAIN_ROWS, TREES, DEPTH, THRESHOLD, MASK = 14, 4, 20_000, 15, 6, 0.5, "[SECRET]"

#: Words that speak for a secret, words that speak against one, and common parts of names.
FOR = "password passwd pwd secret token apikey api_key key auth credential credentials bearer private access_key".split()
AGAINST = "example sample dummy placeholder commit sha sha1 md5 checksum hash uuid guid revision etag order invoice card phone tel isbn version build".split()
DICTIONARY = "example sample dummy test user name file path home main src lib bin data page site index image photo video build version release config setting default module package class method function value field table report summary article chapter section number order invoice customer product service server client socket thread process system network windows linux python java script style color width height title header footer button window docs readme license the and for with from this that your http https www com org net".split()
PREFIXES = "AKIA ASIA ghp_ gho_ ghs_ glpat- sk_live_ rk_live_ xoxb- xoxp- AIza SG. eyJ".split()

#: Services' keys can lack a digit; their prefix is enough.
KNOWN = "|".join(p.replace(".", "[.]") for p in PREFIXES)
def _any(words: list[str]) -> str:
    return "(" + "|".join(re.escape(w).replace("\\-", "-").replace("\\_", "_") for w in sorted(words, key=len, reverse=True)) + ")"


TOKEN = "[A-Za-z0-9_/+.-]"
#: White space beside the blank, between words.
WHITE = "\\t\\n\\r\\f"
#: The local part of a mail address; the same form behind scheme://user: is a password.
#: One class and no repeated group, which would recurse once a label.
MAIL = rf"(?:(?!{TOKEN}+@[A-Za-z0-9-][A-Za-z0-9.-]*[.][A-Za-z]{{2}})|(?<=://[^\s/:@]{{0,4096}}:))"
RUN = lambda least: rf"[A-Za-z0-9]{TOKEN}{{{least - 2},}}[A-Za-z0-9_/+](?![A-Za-z0-9_/+]|{TOKEN}*[A-Za-z0-9])"
CANDIDATE = rf"(?<!{TOKEN})(?={TOKEN}*[0-9]|{KNOWN}){MAIL}{RUN(MIN_LENGTH)}"
#: What assigns to a secret's name, and shorter runs behind it: in one word, or at the start of a word.
ASSIGNS = rf"(?i:{_any(FOR)})[^A-Za-z0-9]{{0,3}}[=:][^A-Za-z0-9]{{0,3}}"
ASSIGNED = rf"(?<!{TOKEN})(?<={ASSIGNS}){MAIL}{RUN(MIN_ASSIGNED)}"
STARTS = rf"(?<!{TOKEN})(?<=^[^A-Za-z0-9]{{0,3}}){MAIL}{RUN(MIN_ASSIGNED)}"
#: A cheap test that every text with a candidate passes.
HINT = rf"[0-9]|{KNOWN}|(?i:{_any(FOR)})[^A-Za-z0-9]{{0,3}}[=:]"


def _q(s: str) -> str:
    return "r'" + s + "'"


#: Features as SQL over the fields of a candidate c.
FEATURES = {
    "length": "length(c.candidate)",
    "transitions": f"length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(c.candidate, {_q('[a-z]')}, 'a'), {_q('[A-Z]')}, 'B'), {_q('[0-9]')}, '1'), {_q('[^aB1]')}, '-'), {_q('(.)' + chr(92) + '1+')}, '$1')) / length(c.candidate)",
    "digits": f"length(regexp_replace(c.candidate, {_q('[^0-9]')}, '')) / length(c.candidate)",
    "capitals": f"length(regexp_replace(c.candidate, {_q('[^A-Z]')}, '')) / length(c.candidate)",
    "signs": f"length(regexp_replace(c.candidate, {_q('[A-Za-z0-9]')}, '')) / length(c.candidate)",
    "vowels": f"length(regexp_replace(c.candidate, {_q('[^AEIOUaeiou]')}, '')) / length(c.candidate)",
    "dictionary": f"1 - length(regexp_replace(lower(c.candidate), {_q(_any(DICTIONARY))}, '')) / length(c.candidate)",
    "different": "size(array_distinct(split(c.candidate, ''))) / length(c.candidate)",
    "hex": f"cast(c.candidate rlike {_q('^[0-9a-fA-F]+$')} as int)",
    "slashes": f"length(regexp_replace(c.candidate, {_q('[^/.]')}, '')) / length(c.candidate)",
    "prefix": f"cast(c.candidate rlike {_q('^' + _any(PREFIXES))} as int)",
    "named": f"cast(concat(c.before, ' ', c.lead) rlike {_q('(?:^|[^a-z])' + _any(FOR) + '[^a-z]')} as int)",
    "assigned": f"cast(concat(c.before, ' ', c.lead) rlike {_q(_any(FOR) + '[^a-z0-9]{0,3}[=:][^a-z0-9]{0,3}$')} as int)",
    "against": f"cast(concat(' ', c.before, ' ', c.lead, ' ', c.after, ' ') rlike {_q('[^a-z]' + _any(AGAINST) + '[^a-z]')} as int)",
    "tested": f"cast(c.path rlike {_q('(test|example|sample|fixture|docs?/|readme)')} as int)",
}


def candidates(text: str = "text", path: str | None = None) -> str:
    """SQL: the array of candidates of a text with the words next to them. `_words` must hold the text's words."""
    where = f"lower(coalesce(cast(`{path}` as string), ''))" if path else "''"
    # each word with its place and the two words before it: looking them up in _words for every word could split the text again each time
    two = "zip_with(zip_with(_words, concat(array(''), _words), (w, p) -> struct(w, p)), concat(array('', ''), _words), (z, q) -> struct(z.w as w, z.p as p, q))"
    behind = f"(right(x.p, 1) in ('=', ':') and concat(x.q, ' ', x.p) rlike {_q(ASSIGNS + '$')})"
    inside = f"((instr(x.w, '=') > 1 or instr(x.w, ':') > 1) and x.w rlike {_q(ASSIGNED)})"
    long_words = f"filter(transform({two}, (z, i) -> struct(z.w as w, z.p as p, z.q as q, i)), x -> x.w is not null and ((length(x.w) >= {MIN_LENGTH} and x.w rlike {_q(CANDIDATE)}) or {inside} or ({behind} and x.w rlike {_q(STARTS)})))"
    runs = f"regexp_extract_all(x.w, if({behind}, {_q(f'({CANDIDATE}|{ASSIGNED}|{STARTS})')}, {_q(f'({CANDIDATE}|{ASSIGNED})')}), 1)"
    near = lambda start, size: f"lower(array_join(transform(slice(_words, {start}, {size}), y -> right(y, 60)), ' '))"
    one = f"named_struct('candidate', t, 'word', x.i, 'path', {where}, 'before', {near('greatest(1, x.i - 2)', 'least(3, x.i)')}, 'lead', lower(right(substring_index(x.w, t, 1), 60)), 'after', {near('x.i + 2', '3')})"
    return f"flatten(transform({long_words}, x -> transform({runs}, t -> {one})))"


def findings(spark: SparkSession, rows: int = 8000) -> DataFrame:
    """Labelled findings by rule: (candidate, path, before, lead, after, label)."""
    h = lambda salt: f"sha2(concat(id, '{salt}'), 256)"
    word = "element_at(split('report user summary image invoice config section module article chapter', ' '), cast(id % 10 + 1 as int))"
    base = f"translate(base64(unhex({h('a')})), '+/=', 'xyz')"
    kinds = [
        # candidate, before, lead, label
        (f"concat('AKIA', left(upper(translate({base}, '0189', 'QRST')), 16))", "'and then the'", "''", 1),
        (f"left({h('b')}, 40)", "'with token ='", "'\"'", 1),
        (f"left({h('c')}, 18)", "'of the line'", "'password='", 1),
        (f"concat('ghp_', left({base}, 36))", "'set the env'", "''", 1),
        (f"left({base}, cast(20 + id % 20 as int))", "'our api_key ='", "'\\''", 1),
        (f"concat('sk_live_', left({base}, 24))", "'stripe'", "''", 1),
        (f"left({base}, cast(24 + id % 17 as int))", "'the secret is'", "'secret:'", 1),
        (f"left({base}, 40)", "'auth bearer'", "''", 1),
        (f"left(translate({h('d')}, 'abcdef', '123456'), 16)", "'call now with'", "''", 0),
        (f"left({h('e')}, 40)", "'fixed in commit'", "''", 0),
        (f"left({h('f')}, 32)", "'the md5 checksum'", "'md5:'", 0),
        (f"concat_ws('-', left({h('g')}, 8), substr({h('g')}, 9, 4), substr({h('g')}, 13, 4), substr({h('g')}, 17, 4), substr({h('g')}, 21, 12))", "'request id is'", "'id='", 0),
        (f"concat('src/main/', {word}, '/file', id % 97, '.java')", "'see the file'", "''", 0),
        (f"concat({word}, '-', {word}, '-page-', id % 1000)", "'on the site'", "'/'", 0),
        (f"concat('2024-', lpad(cast(id % 12 as string), 2, '0'), '-', lpad(cast(id % 28 as string), 2, '0'), 'T10:00'  , '')", "'made at'", "''", 0),
        (f"concat('example', {word}, 'key', id % 1000)", "'for example use'", "'api_key='", 0),
        (f"concat('test_', {word}, '_token_', id % 100)", "'in the test'", "'token='", 0),
        (f"concat({word}, '.', id % 90, '@mail', id % 9, '.example.com')", "'write to'", "''", 0),
        (f"concat(substr({h('i')}, 1, 3), '-', translate(substr({h('i')}, 4, 3), 'abcdef', '123456'), '-', translate(substr({h('i')}, 7, 9), 'abcdef', '123456'))", "'phone number'", "'tel:'", 0),
        (f"concat('eyJ', left({base}, 33), '.eyJ', {base}, left({h('j')}, cast(id % 40 as int)), '.', {base})", "'send the header'", "''", 1),
        (f"left({base}, cast(12 + id % 9 as int))", "'connect to'", "'postgres://app:'", 1),
        (f"left({base}, cast(7 + id % 7 as int))", "'then set'", "'password='", 1),
        (f"left(translate({base}, '0123456789', 'ghjkmnpqrs'), cast(12 + id % 12 as int))", "'our secret ='", "'\\''", 1),
        (word, "'the token: '", "''", 0),
        (f"concat('xxxxxxxx', '0000', 'xxxxxxxx', id % 10)", "'replace the'", "'password='", 0),
    ]
    pick = lambda n: "case " + " ".join(f"when id % {len(kinds)} = {k} then {row[n]}" for k, row in enumerate(kinds)) + " end"
    # the same thing is said in many ways: half the rows lose what stands before them
    before = f"case when xxhash64(id, 1) % 4 = 0 then 'of the in' else {pick(1)} end"
    return spark.range(rows).selectExpr(f"{pick(0)} as candidate", "case when id % 7 = 0 then 'docs/readme.md' when id % 5 = 0 then 'src/app.py' else '' end as path", f"{before} as before", f"{pick(2)} as lead", "'and the rest' as after", f"cast({pick(3)} as double) as label")


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, rows: int = TRAIN_ROWS) -> str:
    """The forest as SQL over a candidate's features: the share of trees that say secret."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    data = labelled.where("candidate is not null and label is not null").orderBy(F.xxhash64("candidate", "before"), "candidate", "before", "label").limit(rows)
    data = data.select("label", F.struct("candidate", *(F.coalesce(c, F.lit("")).alias(c) for c in ("path", "before", "lead", "after"))).alias("c")).coalesce(1)
    data = data.selectExpr("label", *(f"cast({sql} as double) as {name}" for name, sql in FEATURES.items()))
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(data)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, featureSubsetStrategy="sqrt").fit(data.select("label", "features"))
    votes = [_tree(t._call_java("rootNode")) for t in model.trees]
    return f"({' + '.join(votes)}) / {float(len(votes))}"


def _tree(node) -> str:
    """A tree's nodes as a CASE expression."""
    if node.getClass().getSimpleName() == "LeafNode":
        return repr(float(node.prediction()))
    split = node.split()
    return f"if(f.{list(FEATURES)[split.featureIndex()]} <= {split.threshold()!r}D, {_tree(node.leftChild())}, {_tree(node.rightChild())})"


def scanned(df: DataFrame, forest: str, text: str = "text", path: str | None = None) -> DataFrame:
    """df with secrets: an array of (candidate, word, score, secret) for each candidate of the text."""
    words = df.withColumn("_words", F.when(F.col(text).rlike(HINT), F.split(text, f"[ {WHITE}]+")).otherwise(F.array().cast("array<string>")))
    found = words.withColumn("_found", F.expr(candidates(text, path)))
    fields = ", ".join(f"'{name}', cast({sql} as double)" for name, sql in FEATURES.items())
    made = found.withColumn("_made", F.expr(f"transform(_found, c -> named_struct('c', c, 'f', named_struct({fields})))"))
    scored = made.withColumn("_scored", F.expr(f"transform(_made, m -> named_struct('c', m.c, 'score', element_at(transform(array(m.f), f -> {forest}), 1)))"))
    out = scored.withColumn("secrets", F.expr(f"transform(_scored, s -> named_struct('candidate', s.c.candidate, 'word', s.c.word, 'score', cast(s.score as double), 'secret', s.score >= {THRESHOLD}))"))
    return out.drop("_words", "_found", "_made", "_scored")


def masked(df: DataFrame, text: str = "text") -> DataFrame:
    """scanned() rows with each secret replaced by MASK in the word in which it was found, and nowhere else; of several in one word longer ones first. The column secrets goes."""
    # words and the white space between them in turn; a text that begins with white space has an empty first word, as in scanned()
    pieces = f"regexp_extract_all(`{text}`, {_q('([^ ' + WHITE + ']+|[ ' + WHITE + ']+)')}, 1)"
    begins = f"cast(`{text}` rlike {_q('^[ ' + WHITE + ']')} as int)"
    mine = "array_sort(filter(_hits, s -> 2 * s.word - _begins = j), (a, b) -> length(b.candidate) - length(a.candidate))"
    hidden = f"array_join(transform({pieces}, (w, j) -> if(exists(_hits, s -> 2 * s.word - _begins = j), aggregate({mine}, w, (t, s) -> replace(t, s.candidate, '{MASK}')), w)), '')"
    marked = df.withColumn("_hits", F.expr("filter(secrets, s -> s.secret)")).withColumn("_begins", F.expr(begins))
    return marked.withColumn(text, F.expr(f"if(size(_hits) > 0, {hidden}, `{text}`)")).drop("secrets", "_hits", "_begins")


def op2(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    found = scanned(documents, train(findings(spark)), path="source")
    return found.select("doc_id", F.explode("secrets").alias("s")).select("doc_id", "s.word", F.sha2("s.candidate", 256).alias("candidate_sha256"), F.length("s.candidate").alias("length"), "s.score", "s.secret")
