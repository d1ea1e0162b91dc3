"""Completions as tokens: a transducer that splits them into reasoning, content and regions with half-open token spans.

A completion is an array of pieces, a piece being a token's text. Atomic markers are whole pieces; the same characters
spelled by several pieces are text. Spelled markers are found in the text of adjacent pieces, wherever these are cut; a
span then covers each piece that holds a part of the marker. One pass marks both kinds, and one fold over what lies
between carries the state, so a row's work follows its length and nothing leaves its row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnframe.functions import PIECE, held

#: Stand between pieces and around markers while a text is taken apart. Neither is a character of any text.
SEP, CUT = "\uffff", "\ufffe"
REGIONS = "array<struct<text:string,start:int,end:int,closed:boolean>>"


@dataclass(frozen=True)
class Machine:
    """Terminals of markers, and moves from state and terminal to state.

    States: start (nothing but white space yet; its text is content), content, reasoning, those of regions, and any others,
    whose text is dropped. Text itself is the terminal blank or words. A marker without a move is text of the state. A move
    to a state with + keeps the marker's text there; one with ! ends a region and begins the next. A region ends closed by a
    terminal of closers. openers do not end reasoning that has an end of its own anywhere (terminal think_end).
    """

    atomic: Mapping[str, str]
    moves: Mapping[tuple[str, str], str]
    spelled: Mapping[str, str] = field(default_factory=dict)
    regions: tuple[str, ...] = ("tool",)
    closers: tuple[str, ...] = ("tool_end",)
    openers: tuple[str, ...] = ()


def quote(x: str) -> str:
    return rf"\Q{x}\E"


def whole(marker: str) -> str:
    """Pattern of a marker that is a piece of its own, in joined pieces."""
    return f"(?<![^{SEP}]){quote(marker)}(?![^{SEP}])"


def completion_tokens(text: Column, specials: tuple[str, ...]) -> Column:
    """The pieces of a text: specials are one each, the rest is cut as any text."""
    return F.regexp_extract_all(text, F.lit("|".join([*(quote(s) for s in sorted(specials, key=len, reverse=True)), PIECE])), F.lit(0))


def plain(joined: Column) -> Column:
    """Joined pieces as text."""
    return F.replace(joined, F.lit(SEP), F.lit(""))


#: What strip() leaves something of.
_WORDS = r"(?U)[^\s\x1c-\x1f]"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _map(items: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in items.items() for x in kv])


def scan(df: DataFrame, pieces: str, machine: Machine, start: Column) -> DataFrame:
    """df with read, a struct<state, opened, reasoning, content, regions> of its pieces, texts as joined pieces. start is the first state."""
    m = machine
    spelled = {x: f"{SEP}?".join(quote(c) for c in x) for x in sorted(m.spelled, key=len, reverse=True)}
    pattern = "|".join([*map(whole, m.atomic), *spelled.values()])
    names, moves = _map({**m.spelled, **m.atomic}), _map({f"{a} {b}": to for (a, b), to in m.moves.items()})
    inside = lambda s: s.isin(*m.regions)
    cut = F.split(F.regexp_replace(F.array_join(pieces, SEP), pattern, f"{CUT}$0{CUT}"), CUT)

    def lexeme(x: Column, i: Column) -> Column:
        def made(seen: Column) -> Column:
            terminal = F.when(i % 2 == 1, F.try_element_at(names, seen)).when(seen.rlike(_WORDS), "words").otherwise("blank")
            return F.struct(x.alias("text"), (i % 2 == 1).alias("marker"), terminal.alias("terminal"), (F.length(x) - F.length(seen)).alias("seps"))

        return _let(plain(x), made)

    df = held(df, parts=F.transform(cut, lexeme), begins=start)
    df = held(df, ends=F.exists("parts", lambda x: x["terminal"] == "think_end") if m.openers else F.lit(False))
    ends = F.col("ends")

    def step(acc: Column, x: Column) -> Column:
        text, at, seps = x["text"], acc["at"], x["seps"]

        def move(t: Column) -> Column:
            found = F.try_element_at(moves, F.concat_ws(" ", acc["state"], t))
            blocked = ends & (acc["state"] == "reasoning") & t.isin(*m.openers) if m.openers else F.lit(False)
            moved = lambda to: F.struct(t.alias("terminal"), F.coalesce(F.rtrim(to, F.lit("+!")), acc["state"]).alias("state"), (to.isNull() | to.endswith("+") | ~x["marker"]).alias("keep"), F.coalesce(to.endswith("!"), F.lit(False)).alias("again"))
            return _let(F.when(~blocked, found), moved)

        def result(v: Column) -> Column:
            was, now = inside(acc["state"]), inside(v["state"])
            closed = v["terminal"].isin(*m.closers)
            left, entered = was & (~now | v["again"]), now & (~was | v["again"])
            done = F.struct(F.concat(acc["region"], F.when(closed, text).otherwise("")).alias("text"), acc["begun"].alias("start"), (at + F.when(closed, seps + 1).otherwise(0)).alias("end"), closed.alias("closed"))
            grown = lambda c, states: F.when(v["keep"] & v["state"].isin(*states), F.concat(acc[c], text)).otherwise(acc[c]).alias(c)
            return F.struct(
                (at + seps).alias("at"), v["state"].alias("state"), (acc["opened"] | (v["state"] == "reasoning")).alias("opened"),
                grown("reasoning", ["reasoning"]), grown("content", ["start", "content"]),
                F.when(entered, text).when(now, F.concat(acc["region"], text)).otherwise("").alias("region"), F.when(entered, at).otherwise(acc["begun"]).alias("begun"),
                F.when(left, F.concat(acc["regions"], F.array(done))).otherwise(acc["regions"]).cast(REGIONS).alias("regions"),
            )

        return _let(move(x["terminal"]), result)

    begin = F.struct(
        F.lit(0).alias("at"), F.col("begins").alias("state"), (F.col("begins") == "reasoning").alias("opened"), F.lit("").alias("reasoning"), F.lit("").alias("content"),
        F.lit("").alias("region"), F.lit(0).alias("begun"), F.array().cast(REGIONS).alias("regions"),
    )

    def finish(acc: Column) -> Column:
        rest = F.struct(acc["region"].alias("text"), acc["begun"].alias("start"), F.size(pieces).alias("end"), F.lit(False).alias("closed"))
        return F.struct(
            acc["state"].alias("state"), acc["opened"].alias("opened"), acc["reasoning"].alias("reasoning"), acc["content"].alias("content"),
            F.when(inside(acc["state"]), F.concat(acc["regions"], F.array(rest))).otherwise(acc["regions"]).cast(REGIONS).alias("regions"),
        )

    return held(df, read=F.aggregate("parts", begin, step, finish)).drop("parts", "begins", "ends")
