"""Text search, typeahead and the work of a search page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirwise.functions.values import any_of, bind, filled, present, text, trim_all, up_to
from dirwise.operators.ranking import latest

INDEX_COLUMNS = ("name", "la", "region", "address", "description")


def words(c: Column | str) -> Column:
    """Lower-case word pieces of a text, accents kept."""
    low = F.lower(text(c) if isinstance(c, str) else c)
    return F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda w: w != "")


# English endings taken off before words are compared, longest first.
ENDINGS = ("ational", "ization", "fulness", "iveness", "ousness", "ations", "ation", "ingly", "ments", "ment", "ness", "ings", "ing",
           "edly", "ies", "ed", "es", "ly", "s")


def stem(w: Column) -> Column:
    """A light stem: one ending off where at least three letters stay.

    It brings plural, past and -ing forms together; it is coarser than a full
    Porter stemmer and, as a built-in expression, needs no Python worker.
    """
    return F.regexp_replace(w, rf"^(.{{3,}}?)(?:{'|'.join(ENDINGS)})$", "$1")


def token_table(df: DataFrame, key: str, columns) -> DataFrame:
    """(term, key, hits): the search index of a table, one row per distinct word and row."""
    all_words = F.concat(*[words(c) for c in columns])
    return df.select(key, F.explode(F.transform(all_words, stem)).alias("term")).groupBy("term", key).agg(F.count("*").alias("hits"))


def query_terms(query: str) -> list[str]:
    import re

    return [w for w in re.split(r"[\W_]+", query.lower()) if w]


def _term_match(query: str, word: Column) -> list[Column]:
    """One condition per query word; the last word matches as a prefix."""
    terms = query_terms(query)
    stems = [stem(F.lit(t)) for t in terms]
    return [word == s for s in stems[:-1]] + [word.startswith(stems[-1])] if terms else []


def _matcher(query: str, i: int):
    return lambda w: _term_match(query, w)[i]


def search(df: DataFrame, query: str, key: str = "id", columns=INDEX_COLUMNS, limit: int | None = 50) -> DataFrame:
    """(key, score) of rows holding every query word, the last one as a prefix; best first.

    score counts matching words. The rows are scanned once; for many queries
    over one corpus use ``search_index`` on a saved ``token_table``.
    """
    if not query_terms(query):
        return df.select(key, F.lit(0).cast("bigint").alias("score")).limit(0)
    # a word that matches starts with the term's stem, so rows without these letters need no word splitting
    letters = F.lower(F.concat_ws(" ", *columns))
    maybe = F.lit(True)
    for t in query_terms(query):
        maybe = maybe & F.contains(letters, stem(F.lit(t)))
    stems = F.transform(F.concat(*[words(c) for c in columns]), stem)
    n = len(query_terms(query))

    def counted(w: Column) -> Column:
        return F.array(*[F.size(F.filter(w, _matcher(query, i))) for i in range(n)])

    # chosen inside the row: a filter would be moved below and split the text once more per term
    row = F.array(F.struct(F.col(key), bind(stems, counted).alias("c")))
    hits = df.filter(maybe).select(F.inline(F.filter(row, lambda r: F.array_min(r["c"]) > 0)))
    score = F.aggregate("c", F.lit(0).cast("bigint"), lambda a, x: a + x)
    out = hits.select(key, score.alias("score"))
    return out.orderBy(F.desc("score"), key).limit(limit) if limit else out


def search_index(index: DataFrame, query: str, key: str = "id", limit: int | None = 50) -> DataFrame:
    """The same search over a saved token table."""
    conds = _term_match(query, F.col("term"))
    if not conds:
        return index.select(key, F.lit(0).cast("bigint").alias("score")).limit(0)
    hits = [F.sum(F.when(c, F.col("hits"))).alias(f"_c{i}") for i, c in enumerate(conds)]
    got = index.filter(any_of(conds)).groupBy(key).agg(*hits)
    names = [f"_c{i}" for i in range(len(conds))]
    score = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    out = got.dropna(subset=names).select(key, score.cast("bigint").alias("score"))
    return out.orderBy(F.desc("score"), key).limit(limit) if limit else out


def contains_search(df: DataFrame, query: str, columns=("name", "la", "postcode"), limit: int | None = 50, key: str = "id") -> DataFrame:
    """Plain substring search, case ignored."""
    needle = query.lower()
    return up_to(df.filter(any_of([F.lower(text(c)).contains(needle) for c in columns])).orderBy(key), limit)


# Well-known areas and where they lie.
KEY_AREAS = (
    ("Wimbledon", "Merton, SW19"), ("Kingston", "Kingston upon Thames, KT1"), ("Richmond", "Richmond upon Thames, TW9"),
    ("Putney", "Wandsworth, SW15"), ("Battersea", "Wandsworth, SW11"), ("Clapham", "Lambeth / Wandsworth, SW4"),
    ("Dulwich", "Southwark, SE21"), ("Hampstead", "Camden, NW3"), ("Highgate", "Camden / Haringey, N6"),
    ("Chelsea", "Kensington and Chelsea, SW3"), ("Kensington", "Kensington and Chelsea, W8"), ("Islington", "Islington, N1"),
    ("Camden", "Camden, NW1"), ("Greenwich", "Greenwich, SE10"), ("Blackheath", "Lewisham / Greenwich, SE3"),
    ("Bromley", "Bromley, BR1"), ("Croydon", "Croydon, CR0"), ("Sutton", "Sutton, SM1"), ("Wallington", "Sutton, SM6"),
    ("Cheam", "Sutton, SM3"), ("Epsom", "Surrey Commuter Belt, KT17"), ("Twickenham", "Richmond upon Thames, TW1"),
    ("Teddington", "Richmond upon Thames, TW11"), ("Hampton", "Richmond upon Thames, TW12"),
    ("Surbiton", "Kingston upon Thames, KT6"), ("New Malden", "Kingston upon Thames, KT3"), ("Wembley", "Brent, HA9"),
    ("Harrow", "Harrow, HA1"), ("Stanmore", "Harrow, HA7"), ("Edgware", "Barnet, HA8"), ("Barnet", "Barnet, EN5"),
    ("Finchley", "Barnet, N3"), ("Hendon", "Barnet, NW4"), ("Golders Green", "Barnet, NW11"), ("Muswell Hill", "Haringey, N10"),
    ("Southgate", "Enfield, N14"), ("Enfield", "Enfield, EN1"), ("Stratford", "Newham, E15"), ("Ilford", "Redbridge, IG1"),
    ("Romford", "Havering, RM1"), ("Watford", "Hertfordshire, WD17"), ("Bexley", "Bexley, DA5"), ("Orpington", "Bromley, BR6"),
)


def location_index(df: DataFrame, areas=KEY_AREAS) -> DataFrame:
    """(name, type, subtitle, priority): districts, postcode areas and known towns, one per name.

    A district keeps its name against both others; a town takes a postcode
    area's name. Within a source the row with the smallest id decides.
    """
    region = F.when(filled("region"), F.col("region"))
    districts = df.filter(present("la")).select(
        trim_all("la").alias("name"), F.lit("Borough").alias("type"), F.coalesce(region, F.lit("Greater London")).alias("subtitle"),
        F.lit(1).alias("priority"), F.lit(3).alias("claim"), "id")
    code = F.upper(F.split_part(trim_all(text("postcode")), F.lit(" "), F.lit(1)))
    where = F.when(filled("la"), F.concat(F.col("la"), F.lit(" ("), F.coalesce(region, F.lit("London")), F.lit(")")))
    codes = df.filter(present("postcode")).select(
        code.alias("name"), F.lit("Postcode Area").alias("type"), F.coalesce(where, region, F.lit("UK")).alias("subtitle"),
        F.lit(3).alias("priority"), F.lit(1).alias("claim"), "id")
    spark = df.sparkSession
    towns = spark.createDataFrame([(n, s) for n, s in areas], "name string, subtitle string").select(
        "name", F.lit("Area / Town").alias("type"), "subtitle", F.lit(2).alias("priority"), F.lit(2).alias("claim"), F.lit("").alias("id"))
    every = districts.unionByName(codes).unionByName(towns).withColumn("_key", F.lower("name"))
    # highest claim, then smallest id: compared as (claim, inverted id order) through two maxima
    best = every.groupBy("_key").agg(F.min_by(F.struct("name", "type", "subtitle", "priority"), F.struct(-F.col("claim"), F.col("id"))).alias("b"))
    return best.select("b.*")


def suggest(index: DataFrame, query: str, limit: int | None = 10) -> DataFrame:
    """Names starting with the text before names or subtitles containing it."""
    q = query.strip().lower()
    name = F.lower("name")
    starts = name.startswith(q)
    hit = index.filter(starts | name.contains(q) | F.lower(text("subtitle")).contains(q)) if q else index.limit(0)
    return up_to(hit.orderBy((~starts).cast("int"), "priority", F.length("name"), "name"), limit)


def point_lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == value).limit(1)


def history(log: DataFrame, entity_id: str) -> DataFrame:
    """Logged changes of one entity, newest first."""
    return log.filter(F.col("schoolId") == entity_id).orderBy(F.desc("id"))


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    return latest(rows, [key], [order])
