"""Line dedup by a log-template tree.

A line goes down a tree of fixed depth: its number of tokens (between blanks), then its first
tokens, where a token with a digit counts as a wildcard. Each leaf that lines
of enough documents reach keeps one template: the token that most of its lines
have at a place, or a wildcard where none has the majority. A line that fits
its leaf's template has that one, else its own. A template in enough different
documents recurs, and its lines are dropped from all of them.

Documents are the distinct texts. One with enough tokens in lines of its own
(their leaves are in two documents at most) counts by itself, whatever lines it
shares. One of shared leaves alone is a near copy of others: those with the same least
leaf count as one document, so a group of near copies, however large, keeps
its text for the near-duplicate operators.

The tree is a key, not a data structure: counts are formed before each
shuffle, so a line in a third of all documents costs one row for each document
and no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.sources.storage import materialize

#: A template in at least so many different documents recurs.
MIN_DOCS = 5
#: Leading tokens in a line's path, and the fewest tokens of a line that can recur.
DEPTH, MIN_TOKENS = 3, 1
#: Hundredths of a document's tokens that lines of its own must hold for it to count by itself; documents of their leaves at most.
OWN, OWN_DOCS = 20, 2
#: Share of a leaf template's tokens that must not be wildcards.
MIN_FIXED = 0.7
WILDCARD = "<*>"


def _masked(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.lit(WILDCARD)).otherwise(t))


def _fixed(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: t != WILDCARD))


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _path(line: Column) -> Column:
    """First tokens of a line, masked."""
    return F.array_join(_masked(F.split(F.substring_index(line, " ", DEPTH), " ")), " ")


def _blanks(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def _lines(docs: DataFrame) -> DataFrame:
    """``row`` (digest of the text), its tokens ``total``, and ``place``, ``form``, tokens ``n`` and ``path`` of each line of MIN_TOKENS tokens or more."""
    total = _blanks(F.col("text")) + F.size(F.filter("all_lines", lambda x: x != ""))
    texts = docs.withColumn("all_lines", F.split("text", "\n", -1)).select(_digest(F.col("text")).alias("row"), total.alias("total"), "all_lines")
    lines = texts.select("row", "total", F.posexplode("all_lines").alias("place", "form")).where("form <> ''").withColumn("n", _blanks(F.col("form")) + 1)
    return lines.where(F.col("n") >= MIN_TOKENS).select("row", "total", "place", "form", "n", F.xxhash64("n", _path(F.col("form"))).alias("path"))


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``row`` and ``place`` of every line whose template recurs, once for each text."""
    lines = materialize(_lines(docs), "lines")
    leaves = lines.select("path", "row").distinct().groupBy("path").agg(F.count("*").alias("docs")).where(F.col("docs") > min(OWN_DOCS, min_docs - 1))
    leaves = materialize(leaves.select("path", (F.col("docs") >= min_docs).alias("common")), "leaves")
    found = lines.join(leaves, "path").select("row", "total", "place", "path", "n", "common", _masked(F.split("form", " ")).alias("tokens")).distinct()
    found = materialize(found, "leaf_lines")
    tokens = found.where("common")

    # 60 bits of the leaf's digest, so that its order is that of the digits
    leaf = F.conv(F.substring(F.md5(F.concat_ws(" ", "n", F.array_join(F.slice("tokens", 1, DEPTH), " ")).cast("binary")), 1, 15), 16, 10).cast("long")
    shared = found.select("row", "total", "n", F.when(F.col("common"), leaf).alias("leaf")).groupBy("row").agg(F.sum("n").alias("shared"), F.max("total").alias("total"), F.min("leaf").alias("leaf"))
    itself = 100 * (F.col("total") - F.col("shared")) >= OWN * F.col("total")
    voters = shared.select("row", F.when(itself, F.col("row")).otherwise(F.unhex(F.hex("leaf"))).alias("voter"))

    size = tokens.groupBy("path").agg(F.count("*").alias("lines"))
    votes = tokens.select("path", F.posexplode("tokens").alias("at", "token")).groupBy("path", "at", "token").agg(F.count("*").alias("n"))
    best = votes.groupBy("path", "at").agg(F.max(F.struct("n", "token")).alias("best")).join(size, "path")
    place = F.struct("at", F.when(F.col("best.n") * 2 > F.col("lines"), F.col("best.token")).otherwise(F.lit(WILDCARD)).alias("token"))
    trees = best.groupBy("path").agg(F.array_sort(F.collect_list(place)).alias("places")).select("path", F.transform("places", lambda x: x["token"]).alias("leaf"))
    trees = trees.where(_fixed(F.col("leaf")) >= MIN_FIXED * F.size("leaf"))

    fits = F.forall(F.zip_with("tokens", "leaf", lambda t, m: (m == WILDCARD) | (t == m)), lambda x: x)
    chosen = F.when(F.coalesce(fits, F.lit(False)), F.col("leaf")).otherwise(F.col("tokens"))
    placed = tokens.join(trees, "path", "left").select("row", "place", chosen.alias("template"))
    placed = placed.where(_fixed(F.col("template")) * 2 >= F.size("template")).select("row", "place", _digest(F.array_join("template", " ")).alias("template"))
    recurs = placed.join(voters, "row").select("template", "voter").distinct().groupBy("template").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select("template")
    return placed.join(recurs, "template").select("row", "place")


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with recurring lines dropped from ``text``.

    Copies of a text count once. So do texts that have less than OWN hundredths
    of their tokens in lines of their own and share their least leaf: near
    copies don't make their lines recur. Null texts stay null and
    empty ones empty; a text of nothing but recurring lines becomes empty;
    every input row gives one row; all columns stay, ``n_chars`` (if it is
    there) is brought up to date, and ``n_lines``, ``n_dropped`` are added
    (replaced, if they exist). A line of any length is one line; blank lines
    never recur. An empty table gives an empty result.
    """
    docs = docs.drop("n_lines", "n_dropped")
    source = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    drops = recurring_lines(source, min_docs).groupBy("row").agg(F.collect_set("place").alias("places"))
    columns = docs.columns
    keyed = docs.withColumn("text", F.col("text").cast("string")).withColumn("__text_digest", _digest(F.col("text")))
    joined = keyed.join(drops.withColumnRenamed("row", "__text_digest").withColumnRenamed("places", "__recurring_places"), "__text_digest", "left")
    lines = F.split("text", "\n", -1)
    touched = F.col("__recurring_places").isNotNull()
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__recurring_places")
    kept = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    out = joined.withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0))).withColumn("n_dropped", F.when(touched, F.size("__recurring_places")).otherwise(0))
    out = out.withColumn("text", F.when(touched, kept).otherwise(F.col("text")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns, "n_lines", "n_dropped")


def oracle(docs: str = "documents", columns: str = "doc_id", digests: bool = True) -> str:
    """The same result as DuckDB SQL over a table or subquery ``docs``."""
    mask = f"case when regexp_matches(t, '[0-9]') then '{WILDCARD}' else t end"
    out = "n_lines, n_dropped, length(kept) as kept_chars, md5(kept) as kept_md5" if digests else "kept as text"
    return f"""
    with source as (select *, md5(text) as row_of_text from {docs}),
    raw as (select distinct row_of_text, string_split(text, chr(10)) as ls from source where text is not null),
    marked as (
        select row_of_text, ls, coalesce(list_sum(list_transform(list_filter(ls, lambda x: x <> ''), lambda x: len(string_split(x, ' ')))), 0) as total from raw),
    lines as (select row_of_text, total, unnest(range(len(ls))) as place, unnest(ls) as line from marked),
    paths as (
        select row_of_text, total, place, list_transform(string_split(line, ' '), lambda t: {mask}) as tokens,
               concat_ws(' ', cast(len(string_split(line, ' ')) as varchar), array_to_string(list_transform(string_split(line, ' ')[1:{DEPTH}], lambda t: {mask}), ' ')) as path
        from lines where line <> '' and len(string_split(line, ' ')) >= {MIN_TOKENS}),
    leaves as (select path, count(distinct row_of_text) >= {MIN_DOCS} as common from paths group by path having count(distinct row_of_text) > {min(OWN_DOCS, MIN_DOCS - 1)}),
    found as (select p.*, common from paths p join leaves using (path)),
    leaf_lines as (select * from found where common),
    voters as (
        select row_of_text, case when 100 * (max(total) - sum(len(tokens))) >= {OWN} * max(total) then row_of_text else min(case when common then md5(path)[1:15] end) end as voter
        from found group by row_of_text),
    size as (select path, count(*) as lines from leaf_lines group by path),
    spread as (select path, unnest(range(len(tokens))) as pos, unnest(tokens) as token from leaf_lines),
    votes as (select path, pos, token, count(*) as n from spread group by path, pos, token),
    best as (select path, pos, max(n) as n, max_by(token, struct_pack(n := n, token := encode(token))) as token from votes group by path, pos),
    trees as (
        select path, list(case when n * 2 > lines then token else '{WILDCARD}' end order by pos) as leaf from best join size using (path) group by path),
    good as (select * from trees where len(list_filter(leaf, lambda t: t <> '{WILDCARD}')) >= {MIN_FIXED} * len(leaf)),
    placed as (
        select row_of_text, place,
               case when leaf is not null and len(list_filter(list_zip(tokens, leaf), lambda z: z[2] <> '{WILDCARD}' and z[1] <> z[2])) = 0 then leaf else tokens end as template
        from leaf_lines left join good using (path)),
    keys as (
        select row_of_text, place, array_to_string(template, ' ') as template from placed
        where len(list_filter(template, lambda t: t <> '{WILDCARD}')) * 2 >= len(template)),
    recurs as (select template from keys join voters using (row_of_text) group by template having count(distinct voter) >= {MIN_DOCS}),
    drops as (select distinct row_of_text, place from keys join recurs using (template)),
    rebuilt as (
        select row_of_text, string_agg(line, chr(10) order by place) as kept, count(*) as held
        from lines l anti join drops d using (row_of_text, place) group by row_of_text),
    judged as (
        select s.*, coalesce(len(string_split(s.text, chr(10))), 0) as all_lines, coalesce(r.kept, '') as short_text, coalesce(r.held, 0) as held
        from source s left join rebuilt r using (row_of_text)),
    final as (
        select * exclude (text), cast(all_lines as integer) as n_lines, cast(all_lines - held as integer) as n_dropped,
               case when text is null then null else short_text end as kept from judged)
    select {columns}, {out} from final"""
