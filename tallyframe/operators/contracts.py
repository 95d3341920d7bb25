"""Nested document contracts compiled to counts of broken rules (Q6, Q7).

A contract is a tree of ``Rule``: types, bounds, enumerations, patterns and
lengths at any depth of objects and lists, optional and nullable fields, and
objects closed to unknown keys.  It is checked on a VARIANT, so JSON text (an
enricher's answer) and a row of a table (``to_variant_object``) go one way.

Each node of the tree becomes one array expression, the values that a document
holds at that path; each rule of the node is the number of those values that
break it.  All rules of a table are then summed in ONE aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """What a value must be.  ``kind``: string, integer, number, boolean, list
    or object.  A whole number of any JSON form is an integer; text is never
    taken for a number."""

    kind: str
    required: bool = True
    nullable: bool = False
    minimum: float | None = None
    maximum: float | None = None
    allowed: tuple = ()
    pattern: str | None = None
    min_length: int | None = None
    items: "Rule | None" = None
    fields: dict = field(default_factory=dict)
    closed: bool = False  # an object without keys beside its fields


def _text(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _get(x: str, to: str, path: str = "$") -> str:
    return f"try_variant_get({x}, {_text(path)}, '{to}')"


def _is_kind(x: str, kind: str) -> str:
    t = f"schema_of_variant({x})"
    if kind in ("integer", "number"):
        numeric = f"{t} rlike '^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$'"
        v = _get(x, "double")
        return numeric if kind == "number" else f"({numeric} and coalesce({v} = floor({v}), false))"
    if kind in ("list", "object"):
        return f"startswith({t}, '{'ARRAY<' if kind == 'list' else 'OBJECT<'}')"
    return f"{t} = '{ {'string': 'STRING', 'boolean': 'BOOLEAN'}[kind]}'"


def _count(values: str, broken: str) -> str:
    return f"size(filter({values}, x -> {broken}))"


class _Nodes:
    """Array columns of a contract's nodes, in layers: each layer is made from
    the columns of those before, so a node's values are taken from the document
    once, however many rules look at them."""

    def __init__(self, document: str):
        self.document, self.layers, self.rules = document, [], []

    def column(self, depth: int, text: str) -> str:
        while len(self.layers) <= depth:
            self.layers.append([])
        name = f"{self.document}_{sum(map(len, self.layers))}"
        self.layers[depth].append((name, text))
        return name

    def add_to(self, df: DataFrame) -> DataFrame:
        for layer in self.layers:
            df = df.select("*", *[F.expr(text).alias(name) for name, text in layer])
        return df


def _walk(rule: Rule, path: str, values: str, nodes: _Nodes, depth: int = 0) -> None:
    values = nodes.column(depth, values)
    good = nodes.column(depth + 1, f"filter({values}, x -> not is_variant_null(x) and {_is_kind('x', rule.kind)})")
    number, text = _get("x", "double"), _get("x", "string")
    out = nodes.rules
    if not rule.nullable:
        out.append((path, "null", _count(values, "is_variant_null(x)")))
    out.append((path, "type", f"size(filter({values}, x -> not is_variant_null(x))) - size({good})"))
    if rule.minimum is not None:
        out.append((path, "minimum", _count(good, f"{number} < {float(rule.minimum)!r}D")))
    if rule.maximum is not None:
        out.append((path, "maximum", _count(good, f"{number} > {float(rule.maximum)!r}D")))
    if rule.allowed:
        out.append((path, "allowed", _count(good, f"{text} not in ({', '.join(map(_text, map(str, rule.allowed)))})")))
    if rule.pattern is not None:
        out.append((path, "pattern", _count(good, f"not {text} rlike {_text(rule.pattern)}")))
    if rule.min_length is not None:
        size = f"size({_get('x', 'array<variant>')})" if rule.kind == "list" else f"length({text})"
        out.append((path, "min_length", _count(good, f"{size} < {rule.min_length}")))
    if rule.items is not None:
        _walk(rule.items, f"{path}[]", f"flatten(transform({good}, x -> {_get('x', 'array<variant>')}))",
              nodes, depth + 2)
    if rule.closed:
        names = ", ".join(map(_text, rule.fields))
        out.append((path, "unknown_key", _count(good, f"size(array_except(map_keys("
                                                      f"{_get('x', 'map<string,variant>')}), array({names}))) > 0")))
    for name, child in rule.fields.items():
        quote = '"' if "'" in name else "'"
        value = _get("x", "variant", f"$[{quote}{name}{quote}]")
        held = nodes.column(depth + 2, f"filter(transform({good}, x -> {value}), x -> x is not null)")
        if child.required:
            out.append((f"{path}.{name}", "missing", f"size({good}) - size({held})"))
        _walk(child, f"{path}.{name}", held, nodes, depth + 3)


def broken_rules(df: DataFrame, document: str, contract: Rule) -> tuple[DataFrame, list[tuple[str, str, Column]]]:
    """``df`` with the arrays of the contract's nodes, and (path, rule, number
    of values that break it) of the VARIANT column ``document``.  A document
    that is no JSON breaks (``$``, ``document``) once and no other rule."""
    nodes = _Nodes(document)
    nodes.rules.append(("$", "document", f"cast({document} is null as int)"))
    _walk(contract, "$", f"filter(array({document}), x -> x is not null)", nodes)
    return nodes.add_to(df), [(path, rule, F.expr(text)) for path, rule, text in nodes.rules]


def checked_json(df: DataFrame, json_col: str, contract: Rule) -> DataFrame:
    """``df`` with ``broken`` (``path:rule`` of every broken rule, in order)
    and ``is_valid``."""
    parsed, rules = broken_rules(df.withColumn("_document", F.try_parse_json(json_col)), "_document", contract)
    found = [F.when(n > 0, F.lit(f"{path}:{rule}")) for path, rule, n in rules]
    out = parsed.withColumn("broken", F.filter(F.array(*found), lambda x: x.isNotNull()))
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("broken", "is_valid")], "broken",
                      (F.size("broken") == 0).alias("is_valid"))


def contract_counts(df: DataFrame, contract: Rule, name: str) -> DataFrame:
    """Rows ``document``, ``path``, ``rule``, ``values`` (that break it) and
    ``documents`` (that hold such a value) for all rules of a table's rows,
    from one aggregate; rules that nothing breaks are left out."""
    cols = [f for f in contract.fields if f in df.columns]
    rows = df.select(F.to_variant_object(F.struct(*[F.col(f"`{c}`") for c in cols])).alias("_document"))
    rows, rules = broken_rules(rows, "_document", contract)
    per_row = rows.select(*[n.alias(f"r{i}") for i, (_, _, n) in enumerate(rules)])
    sums = per_row.agg(*[F.sum(f"r{i}").cast("long").alias(f"v{i}") for i in range(len(rules))],
                       *[F.count_if(F.col(f"r{i}") > 0).alias(f"d{i}") for i in range(len(rules))])
    pairs = F.array(*[F.struct(F.lit(path).alias("path"), F.lit(rule).alias("rule"),
                               F.coalesce(F.col(f"v{i}"), F.lit(0)).alias("values"),
                               F.col(f"d{i}").alias("documents"))
                      for i, (path, rule, _) in enumerate(rules)])
    return (sums.select(F.inline(pairs)).where("values > 0")
            .select(F.lit(name).alias("document"), "path", "rule", "values", "documents"))


# --- fixed values: the product's contracts ---------------------------------------------------

_TEXT, _INT, _NUM, _BOOL = Rule("string"), Rule("integer"), Rule("number"), Rule("boolean")


def _maybe(kind: str, **more) -> Rule:
    return Rule(kind, required=False, nullable=True, **more)


SENTIMENT_OUTPUT = Rule("object", closed=True, fields={
    "sentiment": Rule("string", allowed=("positive", "negative", "neutral", "mixed")),
    "score": Rule("number", minimum=-1.0, maximum=1.0),
    "key_themes": Rule("list", required=False, items=_TEXT),
})

OUTLOOK_OUTPUT = Rule("object", closed=True, fields={
    "difficulty_score": Rule("integer", minimum=1, maximum=5),
    "recommendation": Rule("string", min_length=1),
    "best_gameweeks": Rule("list", required=False, items=_INT),
})

TICKER_ROW = Rule("object", fields={
    "team_id": _INT, "team_name": _TEXT, "team_short": _TEXT, "gameweek": _INT,
    "opponent": _TEXT, "opponent_short": _TEXT, "is_home": _BOOL,
    "fdr": Rule("integer", minimum=1, maximum=5), "kickoff_time": _maybe("string"), "season": _TEXT,
})

PICK_ROW = Rule("object", fields={
    "player_id": _INT, "web_name": _TEXT, "team_name": _TEXT, "team_short": _TEXT, "position": _TEXT,
    "price": _NUM, "composite_score": _NUM, "composite_rank": _INT,
    "recommendation": Rule("string", allowed=("buy", "sell", "hold", "watch")),
    "recommendation_reasons": Rule("list", items=_TEXT),
    "form": _NUM, "form_trend": _maybe("string"), "injury_risk": _maybe("integer"),
    "fdr_next_3": _maybe("number"), "net_transfers": _INT, "season": _TEXT, "gameweek": _INT,
})

STRENGTH_ROW = Rule("object", fields={
    "team_id": _INT, "team_name": _TEXT, "team_short": _TEXT, "avg_composite_score": _NUM,
    "total_points": _INT, "avg_form": _NUM, "squad_value": _NUM, "top_scorer_id": _INT,
    "top_scorer_name": _TEXT, "top_scorer_points": _INT, "avg_fdr_remaining": _maybe("number"),
    "player_count": _INT, "enriched_player_count": _INT, "season": _TEXT, "gameweek": _INT,
})

JUDGE_VERDICT = Rule("object", closed=True, fields={
    "scores": Rule("list", items=Rule("object", closed=True, fields={
        "bullet": Rule("integer", minimum=1), "score": Rule("number", minimum=0, maximum=5)})),
    "overall": Rule("number", minimum=0, maximum=5),
    "reasoning": Rule("string", min_length=1),
})
