"""Secret scans with corpus-wide ownership frequency, in column expressions only.

``scan`` finds candidate spans in whole texts: regular expressions give the matches, the pieces
between them give the positions in code points. ``ownership`` aggregates the hashes of the candidate
values by distinct repositories and owners; a value that many owners hold is a copied example, one
that few owners hold and that isn't a placeholder is a live-looking credential, of whatever length.
``findings`` gives one row per span with that verdict; ``redact`` rewrites the texts.

Scale: the texts are read in a narrow pass; only spans (hash, owner, repository) are shuffled, and
groupings run from the finest key upwards, so map-side aggregation has removed the repeats of a hot
value before it meets in one task. No secret leaves the pass in clear: tables hold hashes.

Defined cases: a null or empty text has no spans; null owners or repositories count as one empty
name; a null id stays null; repeated rows each get their own spans (rows are told apart by a row
number, for which the input must be a stored table or otherwise give the same rows when read again);
``redact`` carries all input columns along, whatever their names, the others none; a private key's span runs from BEGIN
to END or, where END is missing, to the end of its base64 words, and its body is what is hashed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, text_or_empty, written


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = rf"""({KEYWORDS})["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""
#: kind: (pattern, group whose text is the value, least characters of the value). A run that is too short is no match at
#: all rather than one to be dropped: as runs end where their letters end, the spans are the same, and prose has no matches.
BASE = {"assign": (ASSIGN, 2, 6), "access": (r"AKIA[A-Z0-9]{16,}", 0, 20), "hex": (r"[0-9a-f]{24,}", 0, 24)}
#: What stands between the words of a key: white space, its escapes, quotes and marks of quoted lines.
_GAP = r"""(?:[ \t-\r"'>#*,|]|\\[nr])"""
_B64 = "[A-Za-z0-9+/]"
_MIXED = "[A-Za-z/]*?(?:[0-9+]|[a-z][A-Z])"
#: A private key up to its END line. Without one: up to the end of the base64 words, of which the last
#: may be short if it is whole (or the text ends there) and doesn't look like prose.
PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*+(?:-{1,4}[^-]++)*+-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_GAP}*+[A-Z][A-Za-z-]*+:{_GAP}++[^ \t-\r\\]++)*+"
    rf"(?:{_GAP}*+(?={_B64}{{40}}|(?={_B64}{{16}}){_MIXED}){_B64}++={{0,2}})*+"
    rf"(?:{_GAP}*+(?={_B64}++=|{_MIXED})(?:(?:{_B64}{{4}})*+(?:{_B64}{{2}}==|{_B64}{{3}}=)?+(?![A-Za-z0-9+/=])|{_B64}++=*+(?![\s\S])))?+"
    r"(?:[ \t-\r]*+-----END [A-Z ]*+-*+)?+)"
)
#: What a key's hash leaves out, so that one key has one hash however its lines are broken.
PEM_FRAME = rf"-----(?:BEGIN|END) [A-Z ]*+-*+|{_GAP}"
#: The wider kinds: pattern, and what a match of it starts with.
WIDER = {
    "pem": (PEM, "-----"),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", "gh"),
    # a token starts a run of its letters (or follows an escaped line end), so a run is looked at once
    "jwt": (r"(?:(?<![A-Za-z0-9_-])|(?<=\\[nrt]))eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", "eyJ"),
    "login": (r"://[A-Za-z0-9._-]+:[^ /@\t-\r]{6,}@", "://"),
}
WIDER_PATTERN = "|".join(p for p, _ in WIDER.values())
#: Without any of these a text has no match of a wider kind, or of an access key.
WIDER_MARKS, ACCESS_MARKS = ("-----BEGIN ", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "eyJ", "://"), ("AKIA",)
KINDS = (*BASE, *WIDER)


def _runs_from(letters: str, least: int = 4) -> str:
    """Pattern of the beginnings of ``letters``, from ``least`` characters on."""
    out = ""
    for c in reversed(letters[least:]):
        out = f"(?:{c}{out})?"
    return letters[:least] + out


_HEX, _ALPHABET = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
_COUNTING = f"(?:{_HEX})+{_runs_from(_HEX, 0)}|{_runs_from(_HEX)}|(?:1234567890)+{_runs_from('1234567890', 0)}|{_runs_from('1234567890')}|{_runs_from(_ALPHABET)}"
#: Words that mark a placeholder where they are the whole value or stand between other than letters and digits.
PLACEHOLDER = rf"(?i)(?:^|[^A-Za-z0-9])(?:examples?|change_?me|placeholder|your|dummy|x{{4,}}|0{{4,}}|{_COUNTING})(?:[^A-Za-z0-9]|$)|^AKIA[A-Z0-9]*EXAMPLE$"
SPAN = "array<struct<start:int,rank:int,end:int,hash:string,live:boolean>>"


def _let(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def _running(x: Column) -> Column:
    """Inclusive running sums of a short array."""
    return F.aggregate(x, F.array().cast("array<int>"), lambda a, v: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + v)))


def running_sums(x: Column, block: int = 128) -> Column:
    """Inclusive running sums, by blocks: the work is n * block and not n * n."""

    def of(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / block).cast("int")), lambda b: _running(F.slice(v, b * block + 1, block)))
        return _let(parts, lambda p: _let(_running(F.transform(p, lambda q: F.get(q, F.size(q) - 1))), lambda tops: F.flatten(F.transform(p, lambda q, k: F.transform(q, lambda y: y + F.coalesce(F.get(tops, k - 1), F.lit(0)))))))

    return F.when(F.size(x) > 0, _let(x, of)).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, match>>, in code points."""

    def placed(m: Column) -> Column:
        steps = _let(F.split(text, pattern, -1), lambda p: F.transform(m, lambda x, k: F.length(x) + F.length(F.get(p, k))))
        place = lambda x, end: F.struct((end - F.length(x)).alias("start"), end.alias("end"), x.alias("match"))
        return _let(running_sums(steps), lambda ends: F.transform(m, lambda x, k: place(x, F.get(ends, k))))

    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(none))


def _live(value: Column, kind: str) -> Column:
    """True for a value that may be a credential. A private key always may; of a login its password counts."""
    if kind == "pem":
        return F.lit(True)
    if kind == "login":
        value = F.regexp_extract(value, "^://[^:]*:(.*)@$", 1)
    return ~value.rlike(PLACEHOLDER)


def _candidates(text: Column, kind: str) -> Column:
    pattern, group, least = BASE[kind]
    value = (lambda m: F.regexp_extract(m, pattern, group)) if group else (lambda m: m)
    kept = F.filter(matches(text, pattern), lambda x: F.length(value(x["match"])) >= least)
    spans = F.transform(kept, lambda x: _span(x, F.lit(KINDS.index(kind)), value(x["match"]), _live(value(x["match"]), kind)))
    return _marked(text, ACCESS_MARKS, spans) if kind == "access" else spans


def _marked(text: Column, marks: tuple[str, ...], spans: Column) -> Column:
    """``spans`` where the text holds one of the marks; a plain search spares most texts the patterns."""
    some = F.lit(False)
    for m in marks:
        some = some | F.contains(text, F.lit(m))
    return F.when(some, spans.cast(SPAN)).otherwise(F.array().cast(SPAN))


def _wider(text: Column) -> Column:
    def rank(m: Column) -> Column:
        out = F.lit(-1)
        for kind, (_, start) in WIDER.items():
            out = F.when(m.startswith(start), F.lit(KINDS.index(kind))).otherwise(out)
        return out

    def told(m: Column, v: Column) -> Column:
        out = F.lit(False)
        for kind, (_, start) in WIDER.items():
            out = F.when(m.startswith(start), _live(v, kind)).otherwise(out)
        return out

    pem = WIDER["pem"][1]
    # of a key the body counts; a header alone has none and counts itself
    body = lambda m: _let(F.regexp_replace(m, PEM_FRAME, ""), lambda b: F.when(b != "", b).otherwise(m))
    value = lambda m: F.when(m.startswith(pem), body(m)).otherwise(m)
    spans = F.transform(matches(text, WIDER_PATTERN), lambda x: _let(value(x["match"]), lambda v: _span(x, rank(x["match"]), v, told(x["match"], v))))
    return _marked(text, WIDER_MARKS, spans)


def _span(x: Column, rank: Column, value: Column, live: Column) -> Column:
    return F.struct(x["start"].alias("start"), rank.alias("rank"), x["end"].alias("end"), F.sha2(value, 256).alias("hash"), live.alias("live"))


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``row`` (number of the row), the ``keep`` columns, and ``spans`` sorted by start and kind."""
    df = docs.select(F.monotonically_increasing_id().alias("row"), *keep, text_or_empty(text).alias("scanned"))
    t = F.col("scanned")
    spans = F.concat(*[_candidates(t, k) for k in BASE], _wider(t))
    return df.select("row", *keep, F.sort_array(spans).cast(SPAN).alias("spans"))


def ownership(found: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """Per candidate hash: spans, distinct repositories, distinct owners."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    one = found.select(F.explode("spans.hash").alias("hash"), name(owner).alias("owner"), name(repository).alias("repository"))
    one = one.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    one = one.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repositories"))
    # a repository belongs to one owner, so the repositories of a hash add up over its owners
    return one.groupBy("hash").agg(F.sum("n").alias("n_spans"), F.sum("repositories").alias("n_repositories"), F.count("*").alias("n_owners"))


def judged(found: DataFrame, owner: Column, repository: Column, shared_owners: int = 3, shared_repositories: int | None = None) -> DataFrame:
    """One row per span of ``found``: row, start, rank, end, and the verdict.

    verdict: ``shared`` for a value of many owners, else ``live`` or ``dull``. Repositories of few
    owners make a value shared only if ``shared_repositories`` is given."""
    owned = ownership(found, owner, repository)
    shared = F.col("n_owners") >= shared_owners
    if shared_repositories is not None:
        shared = shared | (F.col("n_repositories") >= shared_repositories)
    one = found.select("row", F.explode("spans").alias("s")).select("row", "s.start", "s.rank", "s.end", "s.hash", "s.live")
    verdict = F.when(F.col("shared"), "shared").when(F.col("live"), "live").otherwise("dull")
    # the few spans of each value meet its one row; a hot value's side is split by the adaptive plan
    return one.join(owned.select("hash", shared.alias("shared"), "n_owners", "n_repositories"), "hash").withColumn("verdict", verdict)


def findings(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", owner: Column | None = None, repository: Column | None = None, **limits: int) -> DataFrame:
    """doc_id, kind, start, end, hash, n_owners, n_repositories, verdict: a row per span."""
    found = _found(docs, F.col(doc_id).alias("id"), text, owner, repository)
    kind = F.get(F.array(*map(F.lit, KINDS)), F.col("rank"))
    one = judged(found, F.col("own"), F.col("repo"), **limits).join(found.select("row", "id"), "row")
    return one.select(F.col("id").alias(doc_id), kind.alias("kind"), "start", "end", "hash", "n_owners", "n_repositories", "verdict")


def _found(docs: DataFrame, carried: Column, text: str, owner: Column | None, repository: Column | None) -> DataFrame:
    """The stored scan: row, the ``carried`` column, own, repo, spans; under names of its own, so that no column of ``docs`` clashes."""
    own, repo = _owners(owner, repository)
    rows = docs.select(carried, F.col(text).alias("text"), own.alias("own"), repo.alias("repo"))
    return written(scan(rows, "text", (rows.columns[0], "own", "repo")), "secret-spans")


def _owners(owner: Column | None, repository: Column | None) -> tuple[Column, Column]:
    """By default the source owns one repository per language."""
    return F.col("source") if owner is None else owner, F.concat_ws("/", "source", "lang") if repository is None else repository


def counted(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", owner: Column | None = None, repository: Column | None = None, **limits: int) -> DataFrame:
    """Per document: its spans and how many of them are live-looking or shared."""
    found = _found(docs, F.col(doc_id).alias("id"), text, owner, repository)
    of = lambda v: F.count(F.when(F.col("verdict") == v, 1)).alias(f"n_{v}")
    told = judged(found, F.col("own"), F.col("repo"), **limits).groupBy("row").agg(of("live"), of("shared"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return found.join(told, "row", "left").select(F.col("id").alias(doc_id), "spans", n("n_live"), n("n_shared"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"], x["end"])), ",")


def redact(docs: DataFrame, text: str = "text", verdicts: tuple[str, ...] = ("live",), mark: str = "[REDACTED]", owner: Column | None = None, repository: Column | None = None, changed: str | None = None, **limits: int) -> DataFrame:
    """The documents with each span of a given verdict replaced by ``mark``; other columns unchanged.

    ``changed``: name of a further column that tells where something was replaced. Overlapping spans
    become one mark. A null text stays null. The scan's table holds the documents, so each is read once
    more in place; only those with spans are shuffled to their verdicts."""
    found = _found(docs, F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("doc"), text, owner, repository)
    bad = judged(found, F.col("own"), F.col("repo"), **limits).where(F.col("verdict").isin(*verdicts))
    bad = bad.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("bad"))
    # spans that touch or overlap what came before lengthen the last cut
    step = lambda a, x: F.when((F.size(a) > 0) & (F.get(a, F.size(a) - 1)["end"] >= x["start"]), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(F.get(a, F.size(a) - 1)["start"].alias("start"), F.greatest(F.get(a, F.size(a) - 1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(a, F.array(x)))
    cuts = F.aggregate(F.col("bad"), F.array().cast("array<struct<start:int,end:int>>"), step)
    t = F.col("doc")[text]
    piece = lambda c, x, k: F.substring(t, F.coalesce(F.get(c, k - 1)["end"], F.lit(0)) + 1, x["start"] - F.coalesce(F.get(c, k - 1)["end"], F.lit(0)))
    done = _let(cuts, lambda c: F.concat(F.array_join(F.transform(c, lambda x, k: F.concat(piece(c, x, k), F.lit(mark))), ""), F.substring(t, F.get(c, F.size(c) - 1)["end"] + 1, F.length(t))))
    some = F.size("spans") > 0

    def of(rows: DataFrame, new: Column, hit: Column) -> DataFrame:
        cols = [(new if c == text else F.col("doc")[c]).alias(c) for c in docs.columns]
        return rows.select(*cols, *([hit.alias(changed)] if changed else []))

    hit = F.col("bad").isNotNull()
    marked = of(found.where(some).select("row", "doc").join(bad, "row", "left"), F.when(hit, done).otherwise(t), hit)
    return of(found.where(~some), t, F.lit(False)).union(marked)
