"""Secret scan with multipart credential linking.

Three base kinds are found by their patterns alone. Weak candidates, which on
their own are too common to report (random-looking strings, login names,
service addresses), are reported only where a complementary part lies within
``SCOPE`` code points in the same document: a random string near an access
identifier or a login, a login near a secret, an address near both. Parts are
joined by the cells of a grid that their scopes touch, as a semi-join, so that
no pairs are listed.

Cases: a null or empty text has no spans; its list is empty, and so is the
text that is hashed. Rows are told apart by a number of their own, so ids may
repeat or be null. Places are code points, ends exclusive.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions.staging import stage
from tillscope.llm.common import documents

SCOPE = 300
# The base patterns, in the order in which kinds are listed, and the least length of a match or its second group.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: Weak kinds: pattern, group whose length counts, least length, further test of the match.
WEAK = {
    "random": (r"[A-Za-z0-9+/_=-]{20,}", 0, 20, "x rlike '[0-9]' and x rlike '[A-Z]' and x rlike '[a-z]'"),
    "login": (r"""((?i:username|user|login|account|client_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", 2, 3, None),
    "address": (r"""https?://[^\x20\x09-\x0D"'<>]+""", 0, 12, None),
}
KINDS = [*BASE, *WEAK]
_BLOCK = 64


def _quoted(pattern: str) -> str:
    return "r\"" + pattern.replace('"', "\\x22") + "\""


def _prefilter(kind: str, pattern: str, least: int) -> str:
    """A condition that holds for every text with a match that counts, and is quick to test."""
    return {"access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}", "random": "[A-Za-z0-9+/_=-]{20}"}.get(kind, pattern)


def with_spans(docs: DataFrame, kinds: dict, text: str = "text") -> DataFrame:
    """Add a column ``kind``_spans per kind: an array of (start, k, end) of the matches that count, k the kind's place in KINDS.

    Matches and the pieces between them come from the same pattern, so places
    are sums of lengths; the sums run over blocks and then within one, which
    keeps a text with many matches cheap. The matches that don't count still
    use up their characters, as leftmost search wants.
    """
    for kind, (pattern, group, least, *test) in kinds.items():
        p, n = _quoted(pattern), KINDS.index(kind)
        has = f"{text} rlike {_quoted(_prefilter(kind, pattern, least))}"
        if kind == "hex":  # a run is found whole or not at all, so short ones need not be listed
            p = _quoted("[0-9a-f]{24,}")
        docs = docs.withColumn("_m", F.expr(f"if({has}, regexp_extract_all({text}, {p}, 0), null)"))
        docs = docs.withColumn("_p", F.expr(f"if(_m is not null, transform(split({text}, {p}, -1), x -> length(x)), null)"))
        docs = docs.withColumn("_v", F.expr(f"if(_m is not null, transform(regexp_extract_all({text}, {p}, {group}), x -> length(x)), null)") if group else F.expr("transform(_m, x -> length(x))"))
        docs = docs.withColumn("_l", F.expr("transform(_m, (x, i) -> length(x) + _p[i])"))
        docs = docs.withColumn("_b", F.expr(f"transform(sequence(0, greatest(cast(ceil(size(_l) / {_BLOCK}) as int) - 1, 0)), k -> aggregate(slice(_l, {_BLOCK} * k + 1, {_BLOCK}), 0, (a, x) -> a + x))"))
        before = f"aggregate(slice(_b, 1, i div {_BLOCK}), 0, (a, x) -> a + x) + aggregate(slice(_l, (i div {_BLOCK}) * {_BLOCK} + 1, i % {_BLOCK}), 0, (a, x) -> a + x) + _p[i]"
        docs = docs.withColumn("_s", F.expr(f"transform(_m, (x, i) -> named_struct('start', {before}, 'k', {n}, 'end', {before} + length(x), 'ok', _v[i] >= {least} and {(test or [None])[0] or 'true'}))"))
        docs = docs.withColumn(f"{kind}_spans", F.expr("coalesce(transform(filter(_s, s -> s.ok), s -> named_struct('start', s.start, 'k', s.k, 'end', s.end)), array())")).drop("_m", "_p", "_v", "_l", "_b", "_s")
    return docs


def _told(spans: str) -> Column:
    """kind:start:end of the spans, by start and then kind, joined by commas."""
    names = "array(" + ", ".join(f"'{'linked_' * (k in WEAK)}{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform(array_sort({spans}), s -> concat({names}[s.k], ':', s.start, ':', s.end)), ',')")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, spans per base kind, ``linked`` (weak spans with complementary parts), one row per document."""
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    rows = with_spans(rows, BASE | WEAK)
    base = "concat(" + ", ".join(f"{k}_spans" for k in BASE) + ")"
    weak = "concat(" + ", ".join(f"{k}_spans" for k in WEAK) + ")"
    rows = rows.select("row", "doc_id", *(f"{k}_spans" for k in BASE), F.expr(weak).alias("weak"))
    rows = rows.withColumn("weak", F.expr(f"filter(weak, w -> not exists({base}, s -> s.start < w.end and w.start < s.end))"))
    rows = stage(rows, "spans")
    parts = rows.where("size(weak) > 0").select("row", F.explode(F.expr(f"concat({base}, weak)")).alias("s")).select("row", "s.*")
    names = {i: k for i, k in enumerate(KINDS)}
    k = {name: i for i, name in names.items()}
    # a part is in the cells that its scope touches; a weak candidate in the cells of its own place
    cells = lambda a, b: F.explode(F.sequence(F.floor((F.col("start") - a) / scope), F.floor((F.col("end") + b - 1) / scope))).alias("cell")
    here = parts.where(F.col("k") >= len(BASE)).select("row", "start", "k", "end", cells(0, 0))

    def beside(found: DataFrame, *kinds: str) -> DataFrame:
        """Those of ``found`` that are within the scope of a part of such a kind, and not that part itself."""
        other = parts.where(F.col("k").isin([k[x] for x in kinds])).select(
            F.col("row").alias("_row"), F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("k").alias("_k"), cells(scope, scope).alias("_cell"))
        near = (F.col("_row") == F.col("row")) & (F.col("_cell") == F.col("cell")) & (F.col("_start") < F.col("end") + scope) & (F.col("_end") + scope > F.col("start"))
        return found.join(other, near & ~((F.col("_k") == F.col("k")) & (F.col("_start") == F.col("start"))), "left_semi")

    identifier, secret = ("access", "login"), ("assign", "hex", "random")
    linked = (beside(here.where(F.col("k") == k["random"]), *identifier)
              .union(beside(here.where(F.col("k") == k["login"]), *secret))
              .union(beside(beside(here.where(F.col("k") == k["address"]), *identifier), *secret)))
    spans = linked.select("row", "start", "k", "end").distinct().groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("start", "k", "end")).alias("linked"))
    out = rows.join(spans, F.col("row") == F.col("_row"), "left")
    return out.select("doc_id", *(f"{x}_spans" for x in BASE), F.coalesce("linked", F.expr("cast(array() as array<struct<start:int,k:int,end:int>>)")).alias("linked"))


def op9_credential_links(spark, folder: str) -> DataFrame:
    out = scan(documents(spark, folder))
    base = "concat(" + ", ".join(f"{k}_spans" for k in BASE) + ")"
    return out.select("doc_id", *(F.size(f"{k}_spans").cast("long").alias(f"n_{k}") for k in BASE), F.sha2(_told(base), 256).alias("base_sha256"),
                      _told(f"concat({base}, linked)").alias("spans"))


def _sql() -> str:
    """The whole result in SQL: spans from the lengths of matches and of the pieces between them, links by interval semi-joins."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    test = {"random": "regexp_matches(x, '[0-9]') and regexp_matches(x, '[A-Z]') and regexp_matches(x, '[a-z]')"}
    found = []
    for kind, (pattern, group, least, *_) in (BASE | WEAK).items():
        p = quoted("[0-9a-f]{24,}" if kind == "hex" else pattern)
        found.append(f"""select r, {KINDS.index(kind)} as k, x, b, b + length(x) as e from (
  select r, x, n, (sum(gap) over w + coalesce(sum(length(x)) over (w rows between unbounded preceding and 1 preceding), 0))::bigint as b
  from (select r, unnest(m) as x, unnest(list_transform(v, lambda y: length(y))) as n, unnest(list_transform(p[1:len(m)], lambda y: length(y))) as gap, unnest(range(len(m))) as i from (
    select r, regexp_extract_all(t, {p}) as m, regexp_extract_all(t, {p}, {group}) as v, string_split_regex(t, {p}) as p from d where regexp_matches(t, {p})))
  window w as (partition by r order by i)) where n >= {least}{' and ' + test[kind] if kind in test else ''}""")
    kinds = {k: i for i, k in enumerate(KINDS)}
    numbers = lambda *names: ", ".join(str(kinds[x]) for x in names)
    near = lambda *names: f"""exists (select 1 from parts o where o.r = w.r and o.k in ({numbers(*names)}) and o.b < w.e + {SCOPE} and o.e + {SCOPE} > w.b and not (o.k = w.k and o.b = w.b))"""
    identifier, secret = near("access", "login"), near("assign", "hex", "random")
    name = "case k " + " ".join(f"when {i} then '{'linked_' * (k in WEAK)}{k}'" for k, i in kinds.items()) + " end"
    told = f"string_agg({name} || ':' || b || ':' || e, ',' order by b, k)"
    return f"""
with d as materialized (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
s as materialized ({' union all '.join(found)}),
parts as materialized (select * from s where k < {len(BASE)} or not exists (select 1 from s o where o.r = s.r and o.k < {len(BASE)} and o.b < s.e and s.b < o.e)),
linked as materialized (select * from parts w where (k = {kinds['random']} and {identifier}) or (k = {kinds['login']} and {secret}) or (k = {kinds['address']} and {identifier} and {secret})),
base as (select r, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex, {told} as told from s where k < {len(BASE)} group by r),
every as (select r, {told} as told from (select * from s where k < {len(BASE)} union all select * from linked) group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base.told, '')) as base_sha256, coalesce(every.told, '') as spans
from d left join base using (r) left join every using (r)
"""


OP9_SQL = _sql()
