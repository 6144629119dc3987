"""State machines as rule tables, and their replay over step logs.

A machine is an ordered list of rules (state, condition, next state, action). The conditions
are Spark columns. For each row the first rule that would fire in each state is found in
generated code and packed into one integer: a map from states to states. Maps compose, so a replay is
a scan over segments of any group (``segments.machine_states``) and no step depends on the one before.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightlog.operators.segments import BITS, apply_map, machine_states


@dataclass(frozen=True)
class Rule:
    state: str
    when: str | None  # SQL condition; None always holds
    to: str
    action: str


@dataclass(frozen=True)
class Machine:
    start: str
    rules: tuple[Rule, ...]

    @property
    def states(self) -> list[str]:
        return list(dict.fromkeys(r.state for r in self.rules))

    def table(self) -> list[list[tuple[int, str]]]:
        """[state][rule] -> (next state, action)."""
        pos = {s: i for i, s in enumerate(self.states)}
        return [[(pos[r.to], r.action) for r in self.rules if r.state == s] for s in self.states]

    def code(self) -> Column:
        """First firing rule of every state, packed into one BIGINT."""
        out = F.lit(0).cast("bigint")
        for i, s in enumerate(self.states):
            first = None
            for k, r in enumerate([r for r in self.rules if r.state == s]):
                cond = F.lit(True) if r.when is None else F.coalesce(F.expr(r.when), F.lit(False))
                first = F.when(cond, F.lit(k)) if first is None else first.when(cond, F.lit(k))
            out = out + F.shiftleft(first.cast("bigint"), BITS * i)
        return out


def stepper(machine: Machine):
    table, mask = machine.table(), (1 << BITS) - 1

    def step(state, code):
        to, action = table[state][(int(code) >> (BITS * state)) & mask]
        return to, to * 256 + ACTIONS.index(action)

    return step


def replay(steps: DataFrame, keys: Sequence[str], order: Sequence[str], machine: Machine, segments: int | None = None) -> DataFrame:
    """(keys, order, state, action) after each step; every group starts in the start state."""
    coded = steps.select(*keys, *order, machine.code().alias("_code"))
    table = machine.table()
    found = machine_states(coded, keys, order, "_code", [[to for to, _ in row] for row in table], machine.states.index(machine.start), segments)
    # state and action of every (state before, rule)
    width = max(map(len, table))
    packed = [to * 256 + ACTIONS.index(action) for row in table for to, action in row + [row[-1]] * (width - len(row))]
    at = F.col("_before") * width + apply_map(F.col("_code"), F.col("_before"))
    return decode(found.withColumn("_out", F.get(F.array(*map(F.lit, packed)), at)), machine).drop("_code", "_before", "_out")


def decode(df: DataFrame, machine: Machine) -> DataFrame:
    names = F.array(*[F.lit(visible(s)) for s in machine.states])
    acts = F.array(*[F.lit(a) for a in ACTIONS])
    return df.withColumn("state", F.get(names, F.floor(F.col("_out") / 256).cast("int"))).withColumn(
        "action", F.get(acts, F.col("_out") % 256)
    )


def visible(state: str) -> str:
    """A counter or flag that is part of the state does not show in its name."""
    return state.split("#")[0]


VILLAGE, SEARCHING, BATTLE, OVER, STOP = "村庄待机", "搜索中", "战斗中", "战斗结束", "停止"
LIST, DETAIL, DONATING, BLOCKED, DONE = "捐兵-消息列表", "捐兵-请求详情", "捐兵-增援中", "捐兵-资源不足阻塞", "捐兵-完成"
ACTIONS = [
    "wait", "stop", "deploy", "tap 进攻按钮", "tap 返回按钮", "tap 搜索对手按钮", "tap 下一个按钮", "tap 结束战斗按钮",
    "tap 消息列表按钮", "tap 关闭按钮", "tap 请求条目", "tap 增援按钮", "tap 捐赠确认按钮", "tap 兵种选择栏", "blocked",
]


def battle_machine(empty_limit: int = 3) -> Machine:
    """Columns: all_full, attack, search, next_b, return_b, end_b, n_targets, worth (may be NULL)."""
    rules = [
        Rule(VILLAGE, "all_full", STOP, "stop"),
        Rule(VILLAGE, "attack", SEARCHING, "tap 进攻按钮"),
        Rule(VILLAGE, None, VILLAGE, "wait"),
        Rule(SEARCHING, "return_b AND NOT next_b", VILLAGE, "tap 返回按钮"),
        Rule(SEARCHING, "search", SEARCHING, "tap 搜索对手按钮"),
        Rule(SEARCHING, "coalesce(worth, n_targets > 0) AND n_targets > 0", f"{BATTLE}#0", "deploy"),
        Rule(SEARCHING, "next_b", SEARCHING, "tap 下一个按钮"),
        Rule(SEARCHING, None, SEARCHING, "wait"),
    ]
    for k in range(empty_limit):
        here = f"{BATTLE}#{k}"
        last = k + 1 >= empty_limit
        rules += [
            Rule(here, "n_targets > 0", f"{BATTLE}#0", "deploy"),
            Rule(here, "return_b", OVER, "wait"),
            Rule(here, "end_b", OVER if last else f"{BATTLE}#{k + 1}", "tap 结束战斗按钮" if last else "wait"),
            Rule(here, None, here, "wait"),
        ]
    rules += [
        Rule(OVER, "return_b", VILLAGE, "tap 返回按钮"),
        Rule(OVER, None, OVER, "wait"),
        Rule(STOP, None, STOP, "stop"),
    ]
    return Machine(VILLAGE, tuple(rules))


def donation_machine() -> Machine:
    """Columns: list_b, request, close_b, reinforce, confirm, troops, enough, more (may be NULL)."""
    unselected, selected = f"{DONATING}#0", f"{DONATING}#1"
    return Machine(VILLAGE, (
        Rule(VILLAGE, "list_b", LIST, "tap 消息列表按钮"),
        Rule(VILLAGE, None, VILLAGE, "wait"),
        Rule(LIST, "close_b AND NOT request", VILLAGE, "tap 关闭按钮"),
        Rule(LIST, "request AND enough", DETAIL, "tap 请求条目"),
        Rule(LIST, "request", BLOCKED, "blocked"),
        Rule(LIST, None, LIST, "wait"),
        Rule(BLOCKED, "request AND enough", DETAIL, "tap 请求条目"),
        Rule(BLOCKED, "request", BLOCKED, "blocked"),
        Rule(BLOCKED, "list_b", LIST, "tap 消息列表按钮"),
        Rule(BLOCKED, None, BLOCKED, "wait"),
        Rule(DETAIL, "reinforce", unselected, "tap 增援按钮"),
        Rule(DETAIL, "close_b", VILLAGE, "tap 关闭按钮"),
        Rule(DETAIL, None, DETAIL, "wait"),
        Rule(unselected, "troops", selected, "tap 兵种选择栏"),
        Rule(unselected, None, unselected, "wait"),
        Rule(selected, "confirm", DONE, "tap 捐赠确认按钮"),
        Rule(selected, None, selected, "wait"),
        Rule(DONE, "close_b AND more", LIST, "tap 关闭按钮"),
        Rule(DONE, "close_b", VILLAGE, "tap 关闭按钮"),
        Rule(DONE, None, DONE, "wait"),
    ))


def farm_machine() -> Machine:
    """Columns: all_full, attack, return_b, n_targets."""
    return Machine(VILLAGE, (
        Rule(VILLAGE, "all_full", STOP, "stop"),
        Rule(VILLAGE, "attack", BATTLE, "tap 进攻按钮"),
        Rule(VILLAGE, None, VILLAGE, "wait"),
        Rule(BATTLE, "return_b", OVER, "wait"),
        Rule(BATTLE, "n_targets > 0", BATTLE, "deploy"),
        Rule(BATTLE, None, BATTLE, "wait"),
        Rule(OVER, None, VILLAGE, "tap 返回按钮"),
        Rule(STOP, None, STOP, "stop"),
    ))
