"""Contractors behind mentions on bills and in tenders: joins by rule, connected components, one row an entity.

Every join records its rule and how sure it is; an entity's identity is confirmed only if all its joins are. A telephone number joins
alike names only, and none if it stands with three codes or more; a firm that several portal accounts trade under joins none of them
unless account and payee meet on a linked work.

NULL and empty names are no mentions. Joins are equi-joins on codes, names, sorted words and prefixes of 14 letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from worksight.functions.text import norm_name, person_and_firm
from worksight.storage import components, stored

#: Names of no one in particular, and words that don't tell firms apart.
GENERIC = ("technical manager", "executive engineer", "assistant executive engineer", "chief engineer", "contractor", "na", "nil", "escrow", "the technical manager")
BUSINESS = tuple(
    "enterprises enterprise constructions construction associates electricals electrical engineering engineers works infra infrastructure infrastructures contractor"
    " contractors builders traders services solutions technologies consultants management industries agencies developers projects systems electric civil".split()
)
PREFIX, AGENT_CODES, ALIKE = 14, 3, 0.6


@F.pandas_udf(DoubleType())
def sequence_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff and Obershelp's ratio of two texts, which depends on their order; 0 if one is NULL. Spark has no such function."""
    for a, b in pairs:
        yield pd.Series([0.0 if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def quick_ratio(a: Column, b: Column) -> Column:
    """Upper bound of it: twice the letters in common over all letters."""
    letters = F.array_distinct(F.split(a, ""))
    times = lambda x, letter: F.length(x) - F.length(F.replace(x, letter, F.lit("")))
    both = F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0), lambda n, c: n + F.least(times(a, c), times(b, c)))
    return F.when(F.length(a) + F.length(b) == 0, F.lit(1.0)).otherwise(2.0 * both / (F.length(a) + F.length(b)))


def _sorted_words(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(c, " ")), " ")


def names_agree(a: Column, b: Column) -> Column:
    """Equal names of five letters, the same three words or more in any order, or one cut off after 14 letters or more."""
    known = (a != "") & (b != "") & ~a.isin(*GENERIC) & ~b.isin(*GENERIC)
    reordered = (_sorted_words(a) == _sorted_words(b)) & (F.size(F.split(a, " ")) >= 3) & (F.length(a) >= 8)
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return F.coalesce(known & F.when(a == b, F.length(a) >= 5).otherwise(reordered | ((F.length(short) >= PREFIX) & F.startswith(long, short))), F.lit(False))


def names_alike(a: Column, b: Column) -> Column:
    """With a shared telephone: a word of four letters in common besides business words, or sorted words alike."""
    own = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(c, " "), lambda w: ~w.isin(*BUSINESS) & (w != ""))))
    shared = F.exists(F.array_intersect(own(a), own(b)), lambda w: F.length(w) >= 4)
    return (F.size(own(a)) > 0) & (F.size(own(b)) > 0) & (shared | (sequence_ratio(F.array_join(own(a), " "), F.array_join(own(b), " ")) >= ALIKE))


def mentions_of(bills: DataFrame, tenders: DataFrame) -> DataFrame:
    """(mention, system, name, code, phone, supplier): one row for each time that a name stands somewhere.

    bills: contractor, contractor_code, phone. tenders: contractor, supplier_id, bidders (array of name, ...).
    """
    none = F.lit(None).cast("string")
    paid = bills.select(F.lit("bills").alias("system"), F.col("contractor").alias("name"), F.nullif("contractor_code", F.lit("")).alias("code"), F.nullif("phone", F.lit("")).alias("phone"), none.alias("supplier"))
    awarded = tenders.select(F.lit("portal").alias("system"), F.col("contractor").alias("name"), none.alias("code"), none.alias("phone"), F.col("supplier_id").cast("string").alias("supplier"))
    bid = tenders.select(F.lit("portal").alias("system"), F.explode("bidders.name").alias("name"), none.alias("code"), none.alias("phone"), none.alias("supplier"))
    rows = paid.unionByName(awarded).unionByName(bid).filter("name IS NOT NULL AND name <> ''")
    return rows.withColumn("mention", F.concat_ws(":", "system", "name"))


def _star(rows: DataFrame, key: str, rule: str, sureness: str, detail: Column) -> DataFrame:
    """Edges from the first mention of each key to its others."""
    rows = rows.filter(F.col(key).isNotNull()).select(key, "mention").distinct()
    first = F.min("mention").over(Window.partitionBy(key))
    edges = rows.withColumn("a", first).filter("a <> mention")
    return edges.select("a", F.col("mention").alias("b"), F.lit(rule).alias("rule"), F.lit(sureness).alias("sureness"), detail.alias("detail"))


def entity_edges(mentions: DataFrame, linked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b, rule, sureness, detail), and portal names that were left apart as ambiguous (name, payee).

    linked: (contractor, payee) of accepted links between tenders and works.
    """
    codes = _star(mentions, "code", "register_code", "confirmed", F.concat(F.lit("register contractor code "), F.col("code")))
    suppliers = _star(mentions, "supplier", "portal_supplier", "confirmed", F.concat(F.lit("portal supplier id "), F.col("supplier")))

    agents = mentions.filter("phone IS NOT NULL").groupBy("phone").agg(F.countDistinct("code").alias("n")).filter(f"n >= {AGENT_CODES}")
    phones = mentions.filter("phone IS NOT NULL").select("phone", "mention", norm_name(F.col("name")).alias("norm")).distinct().join(agents, "phone", "left_anti")
    other = phones.select("phone", F.col("mention").alias("other"), F.col("norm").alias("other_norm"))
    alike = phones.join(other, "phone").filter("mention < other").filter(names_alike(F.col("norm"), F.col("other_norm")))
    edge = lambda a, b, rule, detail: (F.col(a).alias("a"), F.col(b).alias("b"), F.lit(rule).alias("rule"), F.lit("inferred").alias("sureness"), detail.alias("detail"))
    by_phone = alike.select(*edge("mention", "other", "register_mobile", F.lit("same registered mobile on bills (not published) and similar name")))

    payees = mentions.filter("system = 'bills'").select("mention", norm_name(F.col("name")).alias("norm")).distinct().filter("norm <> ''")
    named = payees.filter(names_agree(F.col("norm"), F.col("norm")))
    same = _star(named, "norm", "name", "inferred", F.concat(F.lit("same normalised name “"), F.col("norm"), F.lit("”")))
    names = payees.groupBy("norm").agg(F.min("mention").alias("mention"))
    head = F.substring("norm", 1, PREFIX)
    longer = names.select(head.alias("head"), F.col("norm").alias("long"), F.col("mention").alias("long_mention"))
    cut = names.filter(F.length("norm") >= PREFIX).withColumn("head", head).join(longer, "head").filter("norm < long").filter(names_agree(F.col("norm"), F.col("long")))
    truncated = cut.select(*edge("mention", "long_mention", "name", F.concat(F.lit("“"), F.col("norm"), F.lit("” is a truncation of “"), F.col("long"), F.lit("”"))))

    portal = mentions.filter("system = 'portal'").select("mention", "name").distinct().withColumn("parts", person_and_firm(F.col("name")))
    accounts = portal.filter("parts.firm IS NOT NULL").groupBy(F.col("parts.firm").alias("firm")).agg(F.countDistinct("name").alias("accounts"))
    kinds = portal.select("mention", "name", F.explode(F.array(F.struct(F.lit("person").alias("kind"), F.col("parts.person").alias("own")), F.struct(F.lit("firm").alias("kind"), F.col("parts.firm").alias("own")))).alias("x")).select("mention", "name", "x.*").filter("own <> ''")
    keys = lambda c: F.explode(F.array_distinct(F.array(c, F.concat(F.lit("~"), _sorted_words(c)), F.concat(F.lit("^"), F.substring(c, 1, PREFIX)))))
    met = kinds.select("*", keys(F.col("own")).alias("key")).join(names.select("norm", F.col("mention").alias("payee"), keys(F.col("norm")).alias("key")), "key")
    met = met.drop("key").distinct().filter(names_agree(F.col("own"), F.col("norm")))
    if linked is None:
        met = met.withColumn("together", F.lit(False))
    else:
        shared = linked.select(F.col("contractor").alias("name"), norm_name(F.col("payee")).alias("norm"), F.lit(True).alias("together")).distinct()
        met = met.join(shared, ["name", "norm"], "left").withColumn("together", F.coalesce("together", F.lit(False)))
    met = met.join(accounts, F.col("own") == F.col("firm"), "left")
    doubtful = (F.col("kind") == "firm") & (F.coalesce("accounts", F.lit(0)) > 1) & ~F.col("together")
    short = (F.col("kind") == "person") & (F.size(F.split("own", " ")) < 3) & ~F.col("together")
    detail = F.concat(F.lit("portal “"), F.col("name"), F.lit("” ~ payee “"), F.col("norm"), F.when(F.col("together"), "” — also on the same linked work").otherwise("”"))
    across = met.filter(~doubtful & ~short).select(*edge("mention", "payee", "cross_system_name", detail))
    ambiguous = met.filter(doubtful).select("name", F.col("norm").alias("payee")).distinct()
    edges = codes
    for more in (suppliers, by_phone, same, truncated, across):
        edges = edges.unionByName(more)
    return edges, ambiguous


def resolve(bills: DataFrame, tenders: DataFrame, linked: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, (mention, entity) and ambiguous names. Entities are numbered by mentions, most first; ties by their least mention."""
    mentions = stored(mentions_of(bills, tenders), "mentions")
    edges, ambiguous = entity_edges(mentions, linked)
    edges = stored(edges, "edges")
    each = mentions.groupBy("mention", "system", "name").agg(F.count("*").alias("n"))
    root = each.join(components(edges), F.col("mention") == F.col("node"), "left").select("mention", "system", "name", "n", F.coalesce("label", "mention").alias("root"))
    root = stored(root, "roots")
    # numbers follow one order over all entities, so their totals, one narrow row each, pass through one task
    totals = root.groupBy("root").agg(F.sum("n").alias("n"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "root")))
    number = ranked.select("root", F.format_string("C%04d", F.col("rank")).alias("entity"))
    names = root.groupBy("root", "name").agg(F.sum("n").alias("times"))
    shown = names.groupBy("root").agg(F.max_by("name", F.struct("times", F.length("name"), "name")).alias("name"), F.collect_set("name").alias("names"))
    of_edge = edges.join(root.select(F.col("mention").alias("a"), "root"), "a")
    per_rule = of_edge.groupBy("root", "rule").agg(F.count("*").cast("int").alias("n"))
    rules = per_rule.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("rule", "n"))).alias("rules"))
    basis = of_edge.groupBy("root").agg(F.bool_and(F.col("sureness") == "confirmed").alias("sure"), F.slice(F.array_sort(F.collect_set("detail")), 1, 12).alias("evidence"))
    ids = mentions.join(root.select("mention", "root"), "mention").select("root", F.explode(F.array_compact(F.array(F.concat(F.lit("register:"), F.col("code")), F.concat(F.lit("portal:"), F.col("supplier"))))).alias("id"))
    ids = ids.groupBy("root").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    systems = root.groupBy("root").agg(F.array_sort(F.collect_set("system")).alias("systems"))
    out = number.join(shown, "root").join(systems, "root").join(rules, "root", "left").join(basis, "root", "left").join(ids, "root", "left")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    entities = out.select(
        "entity", "name", F.array_sort(F.array_remove("names", F.col("name"))).alias("aliases"), F.coalesce("ids", none("string")).alias("ids"),
        F.when(F.coalesce("sure", F.lit(True)), "confirmed").otherwise("inferred").alias("basis"), F.coalesce("rules", F.create_map().cast("map<string,int>")).alias("rules"),
        F.coalesce("evidence", none("string")).alias("evidence"), "systems",
    )
    return entities, root.join(number, "root").select("mention", "system", "name", "entity"), ambiguous
