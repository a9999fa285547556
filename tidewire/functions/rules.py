"""Rule tables and what they decide: filters, scores, categories, tiers. Rules are data; these functions only read them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A named pattern with a weight."""

    name: str
    pattern: str
    weight: float = 0


@dataclass(frozen=True)
class Gate:
    """Ordered reasons to drop an item: a pattern, a second one that must fit too, and one that rescues."""

    reason: str
    pattern: str
    also: str | None = None
    rescue: str | None = None


@dataclass(frozen=True)
class RuleSet:
    """All tables of a deployment. Everything is small and given by its owner."""

    gates: tuple[Gate, ...] = ()
    scores: tuple[Rule, ...] = ()
    penalties: tuple[Rule, ...] = ()
    risks: str = ""
    secondary_share: float = 0.2
    aliases: dict[str, dict[str, tuple[str, ...]]] = field(default_factory=dict)  # group -> name -> aliases
    actions: dict[str, str] = field(default_factory=dict)
    decisive: tuple[str, ...] = ("deal", "regulation", "governance")
    material: tuple[str, ...] = ()
    ambiguous: tuple[str, ...] = ()
    incident: str = ""
    scope: str = ""
    stop: tuple[str, ...] = ()
    generic: tuple[str, ...] = ()
    signal: str = ""
    keywords: tuple[str, ...] = ()
    acronyms: str = ""
    context: str = ""
    foreign: str = ""
    anchors: str = ""
    category_caps: dict[str, int] = field(default_factory=dict)
    theme_caps: dict[str, int] = field(default_factory=dict)
    category_floors: dict[str, int] = field(default_factory=dict)
    promotion: str = ""
    strategic: str = ""
    technical: str = ""
    source_weights: dict[str, int] = field(default_factory=dict)
    topics: dict[str, str] = field(default_factory=dict)  # alias -> id
    aggregations: tuple[str, ...] = ()
    default_topic: str = "other"
    countries: dict[str, tuple[str, ...]] = field(default_factory=dict)
    urgency: tuple[Rule, ...] = ()
    axes: tuple[str, ...] = ()  # score rules that let a foreign item in
    generic_axis: str = ""  # of these, the one that counts only with a proper name
    proper_names: str = ""


def fits(text: Column, pattern: str) -> Column:
    """Case-insensitive search; an empty pattern never fits, a null text is empty."""
    return F.coalesce(text, F.lit("")).rlike(f"(?i){pattern}") if pattern else F.lit(False)


def gate_fails(title: Column, gate: Gate) -> Column:
    bad = fits(title, gate.pattern)
    if gate.also:
        bad &= fits(title, gate.also)
    return bad & ~fits(title, gate.rescue) if gate.rescue else bad


def reject_reason(title: Column, rules: RuleSet) -> Column:
    """The first gate's reason that applies, or null."""
    return F.coalesce(*(F.when(gate_fails(title, g), g.reason) for g in rules.gates), F.lit(None).cast("string"))


def fails_any(title: Column, rules: RuleSet, reasons: list[str]) -> Column:
    """Whether one of the named gates applies, such as those for price stories."""
    found = F.lit(False)
    for g in rules.gates:
        found = found | gate_fails(title, g) if g.reason in reasons else found
    return found


def alias_entries(rules: RuleSet) -> list[tuple[str, str, str]]:
    """(group, name, alias in lower case) in order; a name is an alias of itself."""
    return [(g, name, a.lower()) for g, names in rules.aliases.items() for name, al in names.items() for a in (name, *al)]


def canonical(name: Column, rules: RuleSet) -> Column:
    """The name that an alias stands for, or null. The first match wins."""
    table: dict[str, str] = {}
    for _, full, alias in alias_entries(rules):
        table.setdefault(alias, full)
    if not table:
        return F.lit(None).cast("string")
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.lower(F.trim(name)))


def mentions(text: Column, rules: RuleSet, group: str | None = None) -> Column:
    """The names with an alias in the text, in the tables' order."""
    found = [F.when(F.exists(F.array(*map(F.lit, (name.lower(), *(a.lower() for a in al)))), lambda a: F.contains(F.lower(text), a)), name) for g, names in rules.aliases.items() if group in (None, g) for name, al in names.items()]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def hits(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Names of the rules that fit, in order."""
    return F.array_compact(F.array(*(F.when(fits(text, r.pattern), r.name) for r in rules))) if rules else F.array().cast("array<string>")


def score(title: Column, entities: Column, strategic: Column | None, rules: RuleSet) -> Column:
    """0..100: the heaviest rule that fits, a share of the others, penalties, a quarter of the strategic score.

    Zero where only a foreign rule fits and nothing anchors the item at home.
    """
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(entities, F.lit("")))
    weights = [F.when(fits(text, r.pattern), float(r.weight)).otherwise(0.0) for r in rules.scores]
    top, total = F.greatest(*weights, F.lit(0.0)), sum(weights[1:], weights[0])
    points = top + F.lit(rules.secondary_share) * (total - top)
    for r in rules.penalties:
        points = points + F.when(fits(text, r.pattern), float(r.weight)).otherwise(0.0)
    if strategic is not None:
        points = points + F.coalesce((strategic * 0.25).cast("int"), F.lit(0))
    clamped = F.greatest(F.lit(0), F.least(F.lit(100), points.cast("int")))
    return F.when(foreign_verdict(title, entities, rules), clamped).otherwise(0) if rules.foreign else clamped


def foreign_axes(title: Column, entities: Column, rules: RuleSet) -> Column:
    """Names of the axes that let a foreign item in; the generic one only if the text holds a proper name."""
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(entities, F.lit("")))
    found = hits(text, tuple(r for r in rules.scores if r.name in rules.axes))
    return F.filter(found, lambda a: (a != rules.generic_axis) | fits(text, rules.proper_names))


def foreign_verdict(title: Column, entities: Column, rules: RuleSet) -> Column:
    """True unless the foreign rule fits without an anchor and without an axis."""
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(entities, F.lit("")))
    return ~fits(text, rules.foreign) | fits(text, rules.anchors) | (F.size(foreign_axes(title, entities, rules)) > 0)


def foreign_reason(title: Column, entities: Column, rules: RuleSet) -> Column:
    """Why foreign_verdict came out as it did; empty for items that aren't foreign."""
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(entities, F.lit("")))
    axes = foreign_axes(title, entities, rules)
    by_axis = F.when(F.size(axes) > 0, F.concat(F.lit("axes: "), F.array_join(axes, "·")))
    return F.when(~fits(text, rules.foreign), "").when(fits(text, rules.anchors), "anchor").otherwise(F.coalesce(by_axis, F.lit("foreign only")))


def primary_category(title: Column, rules: RuleSet) -> Column:
    """The heaviest rule that the title fits, else other."""
    ordered = sorted(rules.scores, key=lambda r: -r.weight)
    return F.coalesce(*(F.when(fits(title, r.pattern), r.name) for r in ordered), F.lit("other"))


def themes(title: Column, entities: Column, rules: RuleSet) -> Column:
    """The capped themes that fit."""
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(entities, F.lit("")))
    return hits(text, tuple(r for r in rules.scores if r.name in rules.theme_caps))


def is_promotion(title: Column, rules: RuleSet) -> Column:
    return fits(title, rules.promotion) & ~fits(title, rules.strategic)


def is_technical(title: Column, rules: RuleSet) -> Column:
    return fits(title, rules.technical) & ~fits(title, rules.strategic)


def risk_bonus(title: Column, rules: RuleSet, points: int = 10) -> Column:
    return F.when(fits(title, rules.risks), points).otherwise(0)


def action_group(event_type: Column, rules: RuleSet) -> Column:
    """The group of an event type; unknown and null are other."""
    if not rules.actions:
        return F.lit("other")
    table = F.create_map(*(F.lit(x) for kv in rules.actions.items() for x in kv))
    return F.coalesce(F.element_at(table, F.coalesce(event_type, F.lit("other"))), F.lit("other"))


def is_material(title: Column, flag: Column | None, rules: RuleSet, strict: bool = False) -> Column:
    """Flagged, or a marker of fact in the title; strict leaves the ambiguous markers out."""
    markers = [m for m in rules.material if not (strict and m in rules.ambiguous)]
    found = F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(F.lower(title), m)) if markers else F.lit(False)
    return found if flag is None else F.coalesce(flag, F.lit(False)) | found


def is_incident(title: Column, lede: Column, rules: RuleSet) -> Column:
    return fits(F.concat_ws(" ", title, lede), rules.incident)


def is_decisive(title: Column, event_type: Column, rules: RuleSet) -> Column:
    return action_group(event_type, rules).isin(*rules.decisive) | is_material(title, None, rules)


def coverage(title: Column, n_tokens: Column, n_entities: Column, material: Column, rules: RuleSet) -> Column:
    """How much an item holds: facts, entities, wide phrases, words."""
    scope = F.regexp_count(F.lower(title), F.lit(rules.scope)) if rules.scope else F.lit(0)
    return F.when(material, 20).otherwise(0) + n_entities * 6 + scope * 5 + F.least(n_tokens, F.lit(12))


def has_signal(title: Column, rules: RuleSet) -> Column:
    """An event word, a strong acronym in context, a name of the first group, or a name with a keyword. Blanks are squeezed out of the title for keywords."""
    squashed = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"\s+", "")
    keyword = F.exists(F.array(*map(F.lit, rules.keywords)), lambda k: F.contains(squashed, k)) if rules.keywords else F.lit(False)
    first = next(iter(rules.aliases), None)
    top = F.size(mentions(title, rules, first)) > 0 if first else F.lit(False)
    named = F.size(mentions(title, rules)) > 0
    return fits(title, rules.signal) | (fits(title, rules.acronyms) & fits(title, rules.context)) | top | (named & keyword)


def gate(title: Column, body: Column, rules: RuleSet, relaxed: bool = False) -> Column:
    """Why an item is dropped, or null. relaxed: a name in the title or the first 300 characters is enough of a signal."""
    signal = F.size(mentions(F.concat_ws(" ", title, F.substring(body, 1, 300)), rules)) > 0 if relaxed else has_signal(title, rules)
    return F.coalesce(reject_reason(title, rules), F.when(~signal, "no signal"))


def source_weight(source: Column, rules: RuleSet, default: int = 2) -> Column:
    """The weight of the first listed name that the source contains."""
    return F.coalesce(*(F.when(F.contains(source, F.lit(name)), w) for name, w in rules.source_weights.items()), F.lit(default))


def tier(title: Column, topic: Column, entities: Column, event_type: Column, rules: RuleSet, first_category: str, second: list[str], third: list[str]) -> Column:
    """1 first category by title, 2 deals and the second topics, 3 regulation and the third topics, 4 a name of the first group, 5 others."""
    group = action_group(event_type, rules)
    return (
        F.when(primary_category(title, rules) == first_category, 1)
        .when(topic.isin(second) | (group == "deal"), 2)
        .when(topic.isin(third) | group.isin("regulation", "governance"), 3)
        .when(F.size(mentions(entities, rules, next(iter(rules.aliases), None))) > 0, 4)
        .otherwise(5)
    )


def tier_by_names(primary: Column, names: Column, event_type: Column, own: list[str], own_topic: str, second: list[str], deals: list[str], third: list[str], hint: str) -> Column:
    """1 an own name or the own topic, 2 deals and the second topics, 3 the third topics, 4 a topic that holds the hint, 5 others."""
    any_own = F.coalesce(F.arrays_overlap(names, F.array(*map(F.lit, own))), F.lit(False))
    return (
        F.when(any_own | (primary == own_topic), 1)
        .when(primary.isin(second) | event_type.isin(deals), 2)
        .when(primary.isin(third), 3)
        .when(F.contains(primary, F.lit(hint)), 4)
        .otherwise(5)
    )


def tier_bonus(tier_: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, (25, 15, 10, 5, 0))), tier_)


def normal_topic(value: Column, rules: RuleSet) -> Column:
    """A topic id from a spelling; unknown ones and aggregations become the default."""
    folded = F.regexp_replace(F.lower(F.trim(value)), r"[\s-]+", "_")
    table = {k.lower().replace(" ", "_").replace("-", "_"): v for k, v in rules.topics.items()} | {v: v for v in rules.topics.values()}
    known = F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), folded)
    return F.when(known.isin(list(rules.aggregations)), rules.default_topic).otherwise(F.coalesce(known, F.lit(rules.default_topic)))


def country(text: Column, rules: RuleSet, noise: tuple[str, ...] = ()) -> Column:
    """The country with most keyword hits; null on a tie or without hits."""
    for n in noise:
        text = F.replace(text, F.lit(n), F.lit(" "))
    text = F.lower(text)
    counted = [F.struct(sum(((F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w) for w in words), F.lit(0.0)).alias("n"), F.lit(c).alias("c")) for c, words in rules.countries.items()]
    every = F.array(*counted)
    most = F.array_max(F.transform(every, lambda s: s["n"]))
    best = F.filter(every, lambda s: s["n"] == most)
    return F.when((most > 0) & (F.size(best) == 1), best[0]["c"])


def urgency(title: Column, rules: RuleSet) -> Column:
    """The first label that fits, or null."""
    return F.coalesce(*(F.when(fits(title, r.pattern), r.name) for r in rules.urgency), F.lit(None).cast("string"))


@dataclass(frozen=True)
class UrgentRouting:
    """Where urgent items go: the home pattern and tabs, the labels that are mirrored whatever the place, those summarised in depth."""

    home: str
    home_tab: str
    other_tab: str
    mirror_tab: str
    always_mirrored: tuple[str, ...] = ()
    deep: tuple[str, ...] = ()
    prefix: str = "urgent"


def is_home(title: Column, hint: Column, routing: UrgentRouting) -> Column:
    """Whether a title with its region's hint speaks of the home market; case counts."""
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(hint, F.lit(""))).rlike(routing.home)


def target_tab(title: Column, hint: Column, routing: UrgentRouting) -> Column:
    return F.when(is_home(title, hint, routing), routing.home_tab).otherwise(F.lit(routing.other_tab))


def mirror_tab(label: Column, title: Column, hint: Column, routing: UrgentRouting) -> Column:
    """The second tab of an item: of labels that always have one, and of the home market; else null."""
    always = label.isin(*routing.always_mirrored) if routing.always_mirrored else F.lit(False)
    return F.when(F.coalesce(always, F.lit(False)) | is_home(title, hint, routing), routing.mirror_tab)


def normal_category(value: Column, categories: list[str], aliases: dict[str, str], default: str) -> Column:
    """A category in one of the known spellings: as it is, with case and outer blanks folded, or by alias; else the default."""
    folded = F.lower(F.trim(value))
    table = {**aliases, **{c.lower(): c for c in reversed(categories)}}
    known = F.create_map(*(F.lit(x) for kv in table.items() for x in kv)) if table else F.lit(None)
    found = F.element_at(known, folded) if table else F.lit(None).cast("string")
    exact = F.when(value.isin(categories), value) if categories else F.lit(None).cast("string")
    return F.coalesce(exact, found, F.lit(default))


def fit_to_post(fit: Column, least: int = 20) -> Column:
    """Whether an item fits what readers share; one that no rule knows stays under the floor."""
    return F.coalesce(fit >= least, F.lit(False))
