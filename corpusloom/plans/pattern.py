"""Dependency patterns compiled to one Spark column expression.

A pattern is ``(nodes, constraints)``::

    nodes       {name: {field or category: regex, "exclude": [category, ...]}}
    constraints {(name1, name2): {"deprels": regex,
                                  "fconstraint": {"intersec": [...], "disjoint": [...]},
                                  "lindist": (low, high)}}

A sentence row holds all its words, so matching needs no join between rows and
no shuffle: ``Pattern.exists`` is a plain filter. Relation constraints are
walked along head pointers (one step per dependent), so the work in a sentence
follows its arcs and not the product of its words. A token is bound to each
constrained node, different tokens to different nodes.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.morph import contiguous, feat, let, view
from ..functions.text import full_match

# The names a pattern may use.
TOKEN_FIELDS = ("form", "lemma", "upos", "xpos")
CATEGORIES = (
    "Abbr", "Animacy", "Aspect", "Case", "Clusivity", "Definite", "Degree", "Evident",
    "Foreign", "Gender", "Mood", "NounClass", "NumType", "Number", "Person", "Polarity",
    "Polite", "Poss", "PronType", "Reflex", "Tense", "Typo", "VerbForm", "Voice",
)
PAIR_RULES = ("deprels", "fconstraint", "lindist")
FEATURE_RULES = ("intersec", "disjoint")

# Rounds in which candidates are narrowed, and the most nodes that are picked one by one: both add to the
# depth of the expression, which Spark's analysis limits.
NARROWINGS = 2
PICKED_NODES = 5


class Pattern:
    """A checked pattern; its methods give columns over an array of words."""

    def __init__(self, nodes: dict, constraints: dict | None = None,
                 extra_categories: tuple[str, ...] = ()):
        self.nodes = dict(nodes)
        self.constraints = dict(constraints or {})
        self.categories = set(CATEGORIES) | set(extra_categories)
        self._check()
        self.bound = [n for n in self.nodes if any(n in pair for pair in self.constraints)]
        self.free = [n for n in self.nodes if n not in self.bound]

    # -- checks ---------------------------------------------------------------

    def _check(self) -> None:
        for name, fields in self.nodes.items():
            unknown = set(fields) - set(TOKEN_FIELDS) - {"exclude"} - self.categories
            if unknown:
                raise KeyError(f"node {name}: unknown fields {sorted(unknown)}")
            excluded = fields.get("exclude", [])
            if not isinstance(excluded, list):
                raise TypeError(f"node {name}: 'exclude' takes a list of categories")
            self._check_categories(excluded)
        for pair, rules in self.constraints.items():
            unknown = set(rules) - set(PAIR_RULES)
            if unknown:
                raise KeyError(f"pair {pair}: unknown constraints {sorted(unknown)}")
            features = rules.get("fconstraint") or {}
            if set(features) - set(FEATURE_RULES):
                raise KeyError(f"pair {pair}: 'fconstraint' takes {FEATURE_RULES}")
            for listed in features.values():
                if not isinstance(listed, list):
                    raise TypeError(f"pair {pair}: feature constraints take a list of categories")
                self._check_categories(listed)
        undefined = {n for pair in self.constraints for n in pair} - set(self.nodes)
        if undefined:
            raise ValueError(f"constraints use undefined nodes {sorted(undefined)}")

    def _check_categories(self, names: list) -> None:
        unknown = set(names) - self.categories
        if unknown:
            raise ValueError(f"unknown categories {sorted(unknown)}")

    # -- predicates -----------------------------------------------------------

    def node_matches(self, name: str, token: Column) -> Column:
        """Does the token meet the node's own restrictions?"""
        test = F.lit(True)
        for key, wanted in self.nodes[name].items():
            if key == "exclude":
                # A token without features does not pass an exclusion.
                absent = token["feats"].isNotNull()
                for category in wanted:
                    absent = absent & feat(token["feats"], category).isNull()
                test = test & absent
            elif key in TOKEN_FIELDS:
                test = test & full_match(token[key], wanted)
            else:
                test = test & full_match(feat(token["feats"], key), wanted)
        return test

    def _as_dependent(self, name: str, token: Column) -> Column:
        """Node restrictions plus the relation patterns under which it depends."""
        test = self.node_matches(name, token)
        for (_, dependent), rules in self.constraints.items():
            if dependent == name and "deprels" in rules:
                test = test & full_match(token["deprel"], rules["deprels"])
        return test

    def _pair_holds(self, pair: tuple[str, str], first: Column, second: Column) -> Column:
        rules = self.constraints[pair]
        test = F.lit(True)
        if "deprels" in rules:
            test = test & (second["head"] == first["id"])
        if "lindist" in rules:
            low, high = rules["lindist"]
            distance = second["id"] - first["id"]
            if low != -math.inf:
                test = test & (distance >= low)
            if high != math.inf:
                test = test & (distance <= high)
        for rule, names in (rules.get("fconstraint") or {}).items():
            for category in names:
                a, b = feat(first["feats"], category), feat(second["feats"], category)
                same = (a == b) if rule == "intersec" else (a != b)
                test = test & F.coalesce(same, F.lit(False))
        return test

    # -- public columns -------------------------------------------------------

    def fields(self) -> tuple[str, ...]:
        """The token fields that the pattern looks at."""
        used = {"id"}
        for wanted in self.nodes.values():
            used |= {k if k in TOKEN_FIELDS else "feats" for k in wanted}
        for rules in self.constraints.values():
            if "deprels" in rules:
                used |= {"head", "deprel"}
            if rules.get("fconstraint"):
                used.add("feats")
        return tuple(sorted(used))

    def candidates(self, name: str, words: Column) -> Column:
        """The words that meet a node's own restrictions, with the fields of the pattern."""
        return self._own(name, view(words, *self.fields()))

    def has_nodes(self, words: Column) -> Column:
        """Does every node have at least one candidate?"""
        return let(view(words, *self.fields()), lambda w: self._some_of_each(w, list(self.nodes)))

    def exists(self, words: Column) -> Column:
        """True where the sentence holds at least one instance of the pattern."""

        def test(w: Column) -> Column:
            free = self._some_of_each(w, self.free)
            return free & self._with_env(w, _Any()) if self.bound else free

        return let(view(words, *self.fields()), test)

    def matches(self, words: Column) -> Column:
        """Array of all instances: a struct of word ids, one field per constrained node."""
        self._needs_constraints()

        def found(w: Column) -> Column:
            return self._with_env(w, _All(self.bound))

        return let(self._usable(words), found)

    def first_match(self, words: Column) -> Column:
        """The smallest instance by word ids, NULL where there is none.

        It carries every node; a node without constraints shows its first candidate.
        """
        self._needs_constraints()

        def found(w: Column) -> Column:
            smallest = self._one_by_one(w) if self._picked() else self._with_env(w, _First(self.bound))
            return let(smallest, lambda b: F.when(b.isNotNull(), F.struct(*[
                (b[n] if n in self.bound else F.get(self._own(n, w), F.lit(0))["id"]).alias(n)
                for n in self.nodes
            ])))

        return let(self._usable(words), found)

    def _usable(self, words: Column) -> Column:
        """No words at all where a node without constraints has no candidate."""
        seen = view(words, *self.fields())
        if not self.free:
            return seen
        return let(seen, lambda w: F.when(self._some_of_each(w, self.free), w).otherwise(F.slice(w, 1, 0)))

    def _some_of_each(self, words: Column, names: list[str]) -> Column:
        test = F.size(words) > 0
        for name in names:
            if self.nodes[name]:
                test = test & self._some(name, words)
        return test

    def _own(self, name: str, words: Column) -> Column:
        return F.filter(words, lambda t: self.node_matches(name, t)) if self.nodes[name] else words

    def _needs_constraints(self) -> None:
        if not self.bound:
            raise ValueError("the pattern has no constraints, so it has no bindings")

    # -- compilation ----------------------------------------------------------

    def _with_env(self, words: Column, mode: "_Any") -> Column:
        """Filter each node's candidates once, then search over them."""
        return self._env(words, lambda e: self._search(e, {}, self._order(), mode))

    def _env(self, words: Column, body: Callable) -> Column:
        """Candidates of every node, narrowed where the search would leap from pool to pool.

        Candidates pass through a lambda argument, which Spark evaluates once
        per sentence; a plain column would be inlined into the inner loops.
        """
        env = F.struct(
            words.alias("words"),
            contiguous(words).alias("dense"),
            *[
                (
                    self._dependents(n, words) if self._is_filtered(n) else words
                ).alias(f"c_{n}")
                for n in self.bound
            ],
        )
        return let(env, lambda e: self._narrowed(e, NARROWINGS, body) if self._leaps() else body(e))

    def _one_by_one(self, words: Column) -> Column:
        """The smallest instance, a node at a time: the first candidate that some instance holds with those before it.

        Each candidate is asked for one instance only, so no product of the pools is listed.
        """

        def pick(env: Column, bound: dict[str, Column], names: list[str]) -> Column:
            if not names:
                ids = [bound[n]["id"] for n in self.bound]
                return F.when(ids[-1].isNotNull(), F.struct(*[i.alias(n) for n, i in zip(self.bound, ids)]))
            name, rest = names[0], names[1:]

            def some(token: Column) -> Column:
                ends = {**bound, name: token}
                return self._holds(name, token, bound) & self._search(env, ends, self._order(tuple(ends)), _Any())

            return let(F.filter(env[f"c_{name}"], some), lambda left: let(
                F.get(F.filter(left, lambda t: t["id"] == F.array_min(left["id"])), F.lit(0)),
                lambda token: pick(env, {**bound, name: token}, rest)))

        return self._env(words, lambda e: pick(e, {}, self.bound))

    # -- narrowing ------------------------------------------------------------

    def _leaps(self) -> bool:
        """Does the search bind a node that no relation and no near window ties to the nodes before it?"""
        relations = [set(p) for p, r in self.constraints.items() if "deprels" in r]
        done: set[str] = set()
        for name, how in self._order():
            if done and how[0] == "scan" and not any(name in p and p & done for p in relations):
                return True
            done.add(name)
        return False

    def _picked(self) -> bool:
        return self._leaps() and len(self.bound) <= PICKED_NODES

    def _narrowed(self, env: Column, rounds: int, body: Callable) -> Column:
        """Leave out candidates without a partner in the other pool of a pair, then go on with ``body``.

        What a rule asks of the partner is summed up first: the different values of its features, and the first
        and last place of each. A pool is compared with these, so a sentence takes words x values and not the
        product of its words. A round narrows all pools by those of the round before. Where one pool is empty, all are.
        """
        if rounds == 0:
            some = F.lit(True)
            for n in self.bound:
                some = some & (F.size(env[f"c_{n}"]) > 0)
            return let(self._pools(env, lambda n: F.when(some, env[f"c_{n}"]).otherwise(F.slice(env["words"], 1, 0))), body)
        sides = [(p, p[i], p[1 - i]) for p, r in self.constraints.items()
                 if r and "deprels" not in r and p[0] != p[1] for i in (0, 1)]
        if not sides:
            return self._narrowed(env, 0, body)
        # the summaries are a lambda argument too: made once, compared with every candidate
        made = F.struct(*[self._summary(p, env[f"c_{other}"]).alias(f"s{i}") for i, (p, _, other) in enumerate(sides)])

        def narrowed(sums: Column) -> Column:
            def partner(pair: tuple[str, str], groups: Column, n: str, token: Column) -> Column:
                return F.exists(groups, lambda g: self._may_hold(pair, n, token, g))

            def pool(n: str) -> Column:
                asked = [(p, sums[f"s{i}"]) for i, (p, name, _) in enumerate(sides) if name == n]
                if not asked:
                    return env[f"c_{n}"]
                return F.filter(env[f"c_{n}"], lambda t: reduce(Column.__and__, [
                    partner(p, groups, n, t) for p, groups in asked]))

            return let(self._pools(env, pool), lambda e: self._narrowed(e, rounds - 1, body))

        return let(made, narrowed)

    def _pools(self, env: Column, pool: Callable) -> Column:
        return F.struct(env["words"].alias("words"), env["dense"].alias("dense"),
                        *[pool(n).alias(f"c_{n}") for n in self.bound])

    def _compared(self, pair: tuple[str, str]) -> list[tuple[str, str]]:
        rules = self.constraints[pair].get("fconstraint") or {}
        return [(rule, category) for rule, names in rules.items() for category in names]

    def _summary(self, pair: tuple[str, str], pool: Column) -> Column:
        """Different values of the compared features in a pool, with the first and last word id of each."""
        names = [c for _, c in self._compared(pair)]
        if not names:
            return F.when(F.size(pool) > 0, F.array(F.struct(
                F.array().cast("array<string>").alias("values"), F.array_min(pool["id"]).alias("lo"),
                F.array_max(pool["id"]).alias("hi"))))
        # values as one text: Spark tells texts apart by hash
        marked = F.filter(F.transform(pool, lambda t: F.struct(
            F.to_json(F.array(*[feat(t["feats"], c) for c in names])).alias("sign"),
            reduce(Column.__and__, [feat(t["feats"], c).isNotNull() for c in names]).alias("whole"),
            t["id"].alias("id"))), lambda m: m["whole"])

        def ends(marks: Column, sign: Column) -> list[Column]:
            if "lindist" not in self.constraints[pair]:
                return [F.lit(0).alias("lo"), F.lit(0).alias("hi")]
            ids = F.filter(marks, lambda m: m["sign"] == sign)["id"]
            return [F.array_min(ids).alias("lo"), F.array_max(ids).alias("hi")]

        return let(marked, lambda marks: F.transform(F.array_distinct(marks["sign"]), lambda s: F.struct(
            F.from_json(s, "array<string>").alias("values"), *ends(marks, s))))

    def _may_hold(self, pair: tuple[str, str], name: str, token: Column, group: Column) -> Column:
        """May the pair hold between the token, as node ``name``, and some word of the group?"""
        test = F.lit(True)
        for i, (rule, category) in enumerate(self._compared(pair)):
            mine, theirs = feat(token["feats"], category), F.get(group["values"], F.lit(i))
            test = test & F.coalesce((mine == theirs) if rule == "intersec" else (mine != theirs), F.lit(False))
        low, high = self.constraints[pair].get("lindist", (-math.inf, math.inf))
        if name == pair[1]:
            low, high = -high, -low
        if low != -math.inf:
            test = test & (group["hi"] >= token["id"] + low)
        if high != math.inf:
            test = test & (group["lo"] <= token["id"] + high)
        return test

    def _some(self, name: str, words: Column) -> Column:
        return F.exists(words, lambda t: self.node_matches(name, t))

    def _dependents(self, name: str, words: Column) -> Column:
        return F.filter(words, lambda t: self._as_dependent(name, t))

    def _is_filtered(self, name: str) -> bool:
        return bool(self.nodes[name]) or any(
            dep == name and "deprels" in rules for (_, dep), rules in self.constraints.items()
        )

    def _order(self, given: tuple[str, ...] = ()) -> list[tuple[str, tuple]]:
        """The order in which nodes are bound after the given ones, and how each is reached.

        Relations come first, along arcs from nodes bound already; the other
        constraints are tests as soon as both of their nodes are bound.
        """
        steps: list[tuple[str, tuple]] = []
        done: set[str] = set(given)
        relations = [p for p, r in self.constraints.items() if "deprels" in r and p[0] != p[1]]

        def add(name: str, how: tuple) -> None:
            steps.append((name, how))
            done.add(name)

        while len(done) < len(self.bound):
            for head, dep in relations:  # up to a head: a single step
                if dep in done and head not in done:
                    add(head, ("head_of", dep))
                    break
            else:
                for head, dep in relations:  # down to the dependents
                    if head in done and dep not in done:
                        add(dep, ("scan",))
                        break
                else:
                    fresh = [p for p in relations if not set(p) & done]
                    near = [
                        (p, r["lindist"]) for p, r in self.constraints.items()
                        if "lindist" in r and len(set(p) & done) == 1
                        and not any(math.isinf(x) for x in r["lindist"])
                    ]
                    if fresh:
                        add(fresh[0][1], ("scan",))
                    elif near:
                        (a, b), (low, high) = near[0]
                        if a in done:
                            add(b, ("window", a, int(math.ceil(low)), int(math.floor(high))))
                        else:
                            add(a, ("window", b, -int(math.floor(high)), -int(math.ceil(low))))
                    else:
                        add(next(n for n in self.bound if n not in done), ("scan",))
        return steps

    def _search(self, env: Column, bound: dict[str, Column],
                steps: list[tuple[str, tuple]], mode: "_Any") -> Column:
        if not steps:
            return mode.found(bound)
        (name, how), rest = steps[0], steps[1:]
        pool = self._pool(env, name, how, bound)
        recheck = how[0] in ("head_of", "window")

        def holds(token: Column) -> Column:
            own = self._as_dependent(name, token) if recheck else F.lit(True)
            return own & self._holds(name, token, bound)

        return mode.over(
            pool, holds, lambda token: self._search(env, {**bound, name: token}, rest, mode)
        )

    def _holds(self, name: str, token: Column, bound: dict[str, Column]) -> Column:
        """Does the token go with the nodes bound before it?"""
        test = F.lit(True)
        for pair in self.constraints:
            if name in pair and set(pair) <= set(bound) | {name}:
                ends = {**bound, name: token}
                test = test & self._pair_holds(pair, ends[pair[0]], ends[pair[1]])
        for other in bound.values():
            test = test & (token["id"] != other["id"])
        return test

    def _pool(self, env: Column, name: str, how: tuple, bound: dict[str, Column]) -> Column:
        words = env["words"]
        if how[0] == "head_of":
            at = bound[how[1]]["head"]
            none = F.slice(words, 1, 0)
            return (
                F.when(F.coalesce(at, F.lit(0)) <= 0, none)
                .when(env["dense"], F.when(at <= F.size(words), F.slice(words, at, F.lit(1))).otherwise(none))
                .otherwise(F.filter(words, lambda t: t["id"] == at))
            )
        if how[0] == "window":
            _, other, low, high = how
            if high < low:
                return F.slice(words, 1, 0)
            start = F.greatest(bound[other]["id"] + low, F.lit(1))
            length = F.greatest(bound[other]["id"] + high - start + 1, F.lit(0))
            return F.when(env["dense"], F.slice(words, start, length)).otherwise(words)
        return env[f"c_{name}"]


class _Any:
    """Is there an instance?"""

    def found(self, bound: dict[str, Column]) -> Column:
        return F.lit(True)

    def over(self, pool: Column, holds: Callable, inner: Callable) -> Column:
        return F.exists(pool, lambda t: holds(t) & inner(t))


class _All(_Any):
    """All instances."""

    def __init__(self, names: list[str]):
        self.names = names

    def found(self, bound: dict[str, Column]) -> Column:
        return F.array(F.struct(*[bound[n]["id"].alias(n) for n in self.names]))

    def over(self, pool: Column, holds: Callable, inner: Callable) -> Column:
        return F.flatten(F.transform(F.filter(pool, holds), inner))


class _First(_All):
    """The smallest instance; keeps one per candidate, never the whole set."""

    def found(self, bound: dict[str, Column]) -> Column:
        return F.struct(*[bound[n]["id"].alias(n) for n in self.names])

    def over(self, pool: Column, holds: Callable, inner: Callable) -> Column:
        return F.array_min(F.transform(F.filter(pool, holds), inner))
