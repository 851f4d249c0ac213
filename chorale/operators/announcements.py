"""Announcements: the first rule that matches gives the variables and the canonical sentence."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    pattern: str
    groups: dict[str, int]
    sentence: str
    use_for_mapping: bool = True


#: Patterns of announcements, in order, and their canonical sentences.
RULES = [
    Rule("(.*) (heeft|hebt) deze groep (aan)?gemaakt", {"admin": 1}, "{admin} heeft deze groep aangemaakt"),
    Rule("(.*) (heeft|hebt)( de)? groep ['“\"]?(.*)['”\"]? (aan)?gemaakt", {"admin": 1, "to_topic": 4}, "{admin} heeft de groep '{to_topic}' aangemaakt"),
    Rule("(.*) created group ['“\"]?(.*)['”\"]?", {"admin": 1, "to_topic": 2}, "{admin} heeft de groep '{to_topic}' aangemaakt"),
    Rule("(.*) (heeft|hebt) (.*) toegevoegd", {"admin": 1, "name": 3}, "{admin} heeft {name} toegevoegd"),
    Rule("(.*) neemt deel via (.*) uitnodiging", {"name": 1, "admin": 2}, "{admin} heeft {name} toegevoegd"),
    Rule("(.*) added (.*)", {"admin": 1, "name": 2}, "{admin} heeft {name} toegevoegd"),
    Rule("(.*) (heeft|hebt) ((?!dit bericht).*) verwijderd", {"admin": 1, "name": 3}, "{admin} heeft {name} verwijderd"),
    Rule("(.*) (bent|is) toegevoegd", {"name": 1}, "{name} is toegevoegd"),
    Rule("(.*) is deelnemer geworden via de uitnodigingslink van deze groep", {"name": 1}, "{name} is toegevoegd"),
    Rule("(.*) (heeft|hebt) de groep verlaten", {"name": 1}, "{name} heeft de groep verlaten"),
    Rule("(.*) left", {"name": 1}, "{name} heeft de groep verlaten"),
    Rule("(.*) is verwijderd", {"name": 1}, "{name} is verwijderd"),
    Rule("(.*) (heeft|hebt) de groepsafbeelding gewijzigd", {"admin": 1}, "{admin} heeft de groepsafbeelding gewijzigd"),
    Rule("(.*) bent nu (een )?beheerder", {"admin": 1}, "{admin} is nu een beheerder", False),
    Rule("(.*) (heeft|hebt) het (groeps)?onderwerp gewijzigd naar ['“\"]?(.*)['”\"]?", {"admin": 1, "to_topic": 4}, "{admin} heeft het onderwerp gewijzigd naar '{to_topic}'"),
    Rule("(.*) (heeft|hebt) het (groeps)?onderwerp gewijzigd van ['“\"]?(.*)['”\"]? naar ['“\"]?(.*)['”\"]?", {"admin": 1, "from_topic": 4, "to_topic": 5}, "{admin} heeft het onderwerp gewijzigd van '{from_topic}' naar '{to_topic}'"),
    Rule("(.*) (heeft|hebt) het (groeps)?onderwerp gewijzigd", {"admin": 1}, "{admin} heeft het onderwerp gewijzigd"),
    Rule("(.*) joined using (.*) invite", {"name": 1, "admin": 2}, "{admin} heeft {name} toegevoegd"),
    Rule(r"(.*) heeft berichten met vervaldatum ingeschakeld\. (Alle n|N)ieuwe berichten verdwijnen( na)? ([0-9]{1,2} (dagen|uren))( nadat ze zijn verzonden)? uit deze chat\.( Tik om dit te wijzigen)?", {"name": 1, "duration": 4}, "{name} heeft berichten met vervaldatum ingeschakeld. Alle nieuwe berichten verdwijnen {duration} nadat ze zijn verzonden uit deze chat.", False),
    Rule(r"(.*) heeft berichten met vervaldatum uitgeschakeld\.( Tik om dit te wijzigen)?", {"name": 1}, "{name} heeft berichten met vervaldatum uitgeschakeld.", False),
    Rule(r"(.*) heeft een nieuw telefoonnummer\. Tik om een bericht te sturen of om het nieuwe nummer toe te voegen\.", {"name": 1}, "{name} heeft een nieuw telefoonnummer. Tik om een bericht te sturen of om het nieuwe nummer toe te voegen.", False),
]
#: How the owner of a phone is addressed.
SELF = ["u", "uw", "you", "your"]
VARIABLES = ["admin", "name", "to_topic", "from_topic", "duration"]


def extract(announcements: DataFrame, message: str = "message", holder: str = "data_holder", sender: str | None = None) -> DataFrame:
    """Adds rule (from 1; null: none), the variables, template and use_for_mapping, in one projection.

    Self-references in admin and name become the holder; quotes around topics go. With ``sender``
    only rows of an empty sender are announcements, the others have no rule. Every pattern is sought
    from the front of a line, as all begin with any text.
    """
    text = F.col(message) if sender is None else F.when(F.col(sender) == "", F.col(message))
    number = F.coalesce(*[F.when(text.rlike(f"(?dm)^{r.pattern}"), k) for k, r in enumerate(RULES, 1)])
    out = announcements.withColumn("rule", number)

    def variable(name: str) -> Column:
        found = [F.when(F.col("rule") == k, F.regexp_replace(F.regexp_extract(text, f"(?dm)^{r.pattern}", r.groups[name]), r"(?U)^\s+|\s+$", "")) for k, r in enumerate(RULES, 1) if name in r.groups]
        c = F.coalesce(*found)
        if name in ("admin", "name"):
            return replace_self(c, F.col(holder))
        return F.regexp_replace(c, '^["”]+|["”]+$', "") if name.endswith("topic") else c

    out = out.select("*", *[variable(v).alias(v) for v in VARIABLES])
    by_rule = lambda value: F.coalesce(*[F.when(F.col("rule") == k, F.lit(value(r))) for k, r in enumerate(RULES, 1)])
    return out.withColumn("template", by_rule(lambda r: r.sentence)).withColumn("use_for_mapping", by_rule(lambda r: r.use_for_mapping))


def replace_self(label: Column, holder: Column) -> Column:
    """The holder where a label is how an export addresses its owner, else the label."""
    return F.when(F.lower(label).isin(SELF), holder).otherwise(label)


def canonical(extracted: DataFrame | None = None) -> Column:
    """The canonical sentence with its variables filled in, all at once; null without a rule."""

    def filled(sentence: str) -> Column:
        parts = [F.coalesce(F.col(x[1:-1]), F.lit("")) if x.startswith("{") else F.lit(x) for x in re.split(r"(\{\w+\})", sentence) if x]
        return F.concat(*parts)

    return F.coalesce(*[F.when(F.col("rule") == k, filled(r.sentence)) for k, r in enumerate(RULES, 1)])


def label_groups(extracted: DataFrame) -> DataFrame:
    """group_id, data_holder, label: for each (conversation, date, template) that every holder has at
    most once, the holders' names form a group and their admins another."""
    key = ["conversation_id", "date", "template"]
    once = extracted.where("use_for_mapping").groupBy(*key).agg(F.count("*").alias("n"), F.countDistinct("data_holder").alias("holders"), F.collect_set(F.struct("data_holder", "name", "admin")).alias("rows")).where("n = holders")
    flat = once.select(*key, F.explode("rows").alias("r")).select(*key, "r.*")
    long = flat.selectExpr(*key, "data_holder", "stack(2, 'name', name, 'admin', admin) as (kind, label)").where("label is not null")
    return long.select("conversation_id", F.sha2(F.concat_ws("|", "conversation_id", F.col("date").cast("string"), "template", "kind"), 256).alias("group_id"), "data_holder", "label").distinct()


def latest_topic(extracted: DataFrame) -> DataFrame:
    """The topic of the latest date; of equal dates the one that sorts last."""
    return extracted.where("to_topic is not null").groupBy("conversation_id").agg(F.max_by("to_topic", F.struct("date", "to_topic")).alias("topic"))
