"""Secret spans in whole texts, split by corpus-wide ownership, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: The base kinds in listed order with their patterns; of an assign match group 2 must have 6 characters.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: The added kind: long runs that mix digits, lower and upper case, when they belong to few owners.
OPAQUE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "opaque")
#: A value's spans are spread over so many tasks when they learn its owners, as a copied example may be in a third of all rows.
SALTS = 16
#: Code points of a piece of text that redact() cuts spans from.
PIECE = 4096


def _matches(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Struct (kind, matches) of all leftmost non-overlapping matches, or null: the gap before each, its length and its group.

    A cheap test comes first, so texts without a match are read once.  Offsets are sums of gaps and lengths, which are left
    to a window over the matches, as an array that grows match by match would take the square of their number.
    """
    lit = F.lit(pattern)
    whole = F.regexp_extract_all(text, lit, F.lit(0))
    lengths = F.transform(whole, lambda w: F.char_length(w))
    gaps = F.slice(F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g)), F.lit(1), F.size(whole))
    pairs = F.arrays_zip(gaps.alias("gap"), lengths.alias("length"), F.regexp_extract_all(text, lit, F.lit(group)).alias("value"))
    return F.when(text.rlike(pattern), F.struct(F.lit(kind).alias("kind"), pairs.alias("matches")))


def _candidates(text: Column) -> Column:
    """The matches of all kinds that occur in the text."""
    kinds = [_matches(text, ASSIGN, 0, 2), _matches(text, ACCESS, 1), _matches(text, HEX, 2), _matches(text, OPAQUE, 3)]
    return F.filter(F.array(*kinds), lambda k: k.isNotNull())


def _spans(swept: DataFrame) -> DataFrame:
    """Rows (__id, owner, repository, kind, start, end, value) of the candidates that hold; an assign match is kept by the
    length of its group 2, an opaque one by its mix of characters; the others' lengths are part of their patterns, as
    their runs can't be entered later."""
    each = swept.where("__some").select("__id", "owner", "repository", F.explode("found").alias("f"))
    each = each.select("__id", "owner", "repository", F.col("f.kind").alias("kind"), F.posexplode("f.matches").alias("i", "m"))
    upto = F.sum(F.col("m.gap") + F.col("m.length")).over(Window.partitionBy("__id", "kind").orderBy("i")).cast("int")
    each = each.select("__id", "owner", "repository", "kind", (upto - F.col("m.length")).alias("start"), upto.alias("end"), F.col("m.value").alias("value"))
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]")
    return each.where(((F.col("kind") != 0) | (F.char_length("value") >= 6)) & ((F.col("kind") != KINDS.index("opaque")) | mixed))


def find_secrets(docs: DataFrame, owner: Column | None = None, repository: Column | None = None, example_owners: int = 3) -> DataFrame:
    """docs with ``secrets``: array<struct<kind, start, end, value, owners, repositories, live, covered>>, by start, then kind.

    ``owners`` and ``repositories`` count the distinct ones, over the whole corpus, in which a value occurs (compared
    by a 128-bit hash).  A value of ``example_owners`` owners or more is a widely copied example, others are live-looking;
    base spans (assign, access, hex) always stay, opaque ones only where live.  Owner is by default the source, a
    repository a source's language part.  Null owners are one owner.  ``covered`` is how far the spans before reach.
    Repeated rows each get their spans and add nothing to the counts; null, empty and very long texts are scanned whole; an
    empty table stays empty; other columns stay, but for one named ``secrets``, which gives way.

    One sweep writes every row with its candidates to the shared folder, and rows without any pass by.  Counts aggregate
    (value, owner) pairs before the exchange, and a value's spans are salted when they learn its counts, so a value in a
    third of all rows is no load.
    """
    docs = docs.drop("secrets")
    owner = F.coalesce(F.col("source"), F.lit("")) if owner is None else owner
    repository = F.concat_ws("/", owner, F.coalesce(F.col("lang"), F.lit(""))) if repository is None else repository
    # whole rows travel as one column, so their names can't clash with ours
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    swept = docs.select(row.alias("__row"), owner.alias("owner"), repository.alias("repository"), _candidates(F.coalesce(F.col("text"), F.lit(""))).alias("found"), F.monotonically_increasing_id().alias("__id"))
    swept = shared.materialize(swept.withColumn("__some", F.size("found") > 0), "sweep")
    value_hash = F.struct(F.xxhash64("value").alias("a"), F.xxhash64(F.lit(1), "value").alias("b"))
    each = shared.materialize(_spans(swept).withColumn("value_hash", value_hash), "spans")
    pairs = each.groupBy("value_hash", "owner", "repository").agg(F.lit(1).alias("one")).groupBy("value_hash", "owner").agg(F.count("*").alias("r"))
    counts = pairs.groupBy("value_hash").agg(F.count("*").alias("owners"), F.sum("r").alias("repositories"))
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    judged = each.drop("owner", "repository").withColumn("salt", F.pmod(F.xxhash64("__id", "start"), F.lit(SALTS)).cast("int")).join(salted, ["value_hash", "salt"])
    judged = judged.withColumn("live", F.col("owners") < example_owners).where(F.col("live") | (F.col("kind") < KINDS.index("opaque")))
    before = Window.partitionBy("__id").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    judged = judged.withColumn("covered", F.coalesce(F.max("end").over(before), F.lit(0)))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    secret = F.struct(kind.alias("kind"), "start", "end", "value", "owners", "repositories", "live", "covered")
    one = F.struct(F.col("start"), F.col("kind").alias("k"), secret.alias("secret"))
    spans = judged.groupBy("__id").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["secret"]).alias("secrets"))
    none = F.array().cast(spans.schema["secrets"].dataType)
    without = swept.where("not __some").select("__row", none.alias("secrets"))
    within = swept.where("__some").select("__row", "__id").join(spans, "__id", "left").select("__row", F.coalesce("secrets", none).alias("secrets"))
    return within.unionByName(without).select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns], "secrets")


def _cut(pieces: Column, begin: Column, end: Column) -> Column:
    """The text from begin to end, of a text cut into pieces; the work follows the length of what is cut out."""
    a, b = F.floor(begin / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    first, last = F.coalesce(F.get(pieces, a), F.lit("")), F.coalesce(F.get(pieces, b), F.lit(""))
    inside = F.substring(first, begin - a * PIECE + 1, end - begin)
    across = F.concat(F.substring(first, begin - a * PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.substring(last, F.lit(1), end - b * PIECE))
    return F.when(begin >= end, "").when(a == b, inside).otherwise(across)


def redact(found: DataFrame) -> DataFrame:
    """Replace every secret of find_secrets() in ``text``: live-looking ones by <secret>, widely copied ones by <example-secret>.

    A span that begins inside those before lengthens them.  Texts without a secret, null ones too, stay as they are.
    """

    def new(pieces: Column) -> Column:
        def step(s: Column) -> Column:
            mark = F.when(s["live"], "<secret>").otherwise("<example-secret>")
            return F.when(s["start"] < s["covered"], "").otherwise(F.concat(_cut(pieces, s["covered"], s["start"]), mark))

        reached = F.array_max(F.transform("secrets", lambda s: s["end"]))
        return F.concat(F.array_join(F.transform("secrets", step), ""), _cut(pieces, reached, F.char_length("text")))

    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    # bound once by an outer lambda, else every span would cut the text anew
    done = F.transform(F.array(pieces), new)[0]
    return found.withColumn("text", F.when(F.size("secrets") > 0, done).otherwise(F.col("text")))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of all documents."""
    found = find_secrets(shared.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    name = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("secrets", lambda s: s["kind"] != "opaque")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"), F.array_join(F.transform("secrets", name), ",").alias("spans"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner FROM documents),
""" + "".join(
    f"""m{k} AS (SELECT doc_id, owner, {k} AS k, '{kind}' AS kind, i, len(w[i]) AS n, v[i] AS value,
       list_sum(list_transform(g[1:i], lambda x: len(x)))::BIGINT + coalesce(list_sum(list_transform(w[1:i-1], lambda x: len(x))), 0)::BIGINT AS start
  FROM (SELECT doc_id, owner, w, v, g, unnest(range(1, len(w) + 1)) AS i FROM (
    SELECT doc_id, owner, regexp_extract_all(text, $a${pattern}$a$) AS w, regexp_extract_all(text, $a${pattern}$a$, {group}) AS v, string_split_regex(text, $a${pattern}$a$) AS g
    FROM d WHERE regexp_matches(text, $a${pattern}$a$)))),
"""
    for k, kind, pattern, group in ((0, "assign", ASSIGN, 2), (1, "access", ACCESS, 0), (2, "hex", HEX, 0), (3, "opaque", OPAQUE, 0))
) + r"""
c AS (SELECT * FROM (SELECT * FROM m0 WHERE len(value) >= 6 UNION ALL SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL
  SELECT * FROM m3 WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]'))),
o AS (SELECT value, count(DISTINCT owner) AS owners FROM c GROUP BY value),
s AS (SELECT doc_id, k, start, kind || ':' || start || ':' || (start + n) AS span FROM c JOIN o USING (value) WHERE k < 3 OR owners < 3),
r AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
        string_agg(span, ',' ORDER BY start, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY start, k) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN r ON d.doc_id IS NOT DISTINCT FROM r.doc_id
"""
