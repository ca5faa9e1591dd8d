"""Cost models: substitution, linear gaps, and any number of affine gap layers (a gap of length l costs open + l * extend)."""

from __future__ import annotations

from dataclasses import dataclass, field

FORBIDDEN = 1 << 28


@dataclass(frozen=True)
class Layer:
    """kind: 'ins' consumes b, 'del' consumes a."""

    kind: str
    open: int
    extend: int

    def __post_init__(self) -> None:
        if self.kind not in ("ins", "del"):
            raise ValueError(f"a layer is 'ins' or 'del', not {self.kind!r}")
        if self.open <= 0 or self.extend <= 0:
            raise ValueError("open and extend costs must be positive")


@dataclass(frozen=True)
class CostModel:
    """sub, ins, dele: None forbids that edge outside the layers."""

    name: str
    sub: int | None
    ins: int | None
    dele: int | None
    layers: tuple[Layer, ...] = field(default=())

    def __post_init__(self) -> None:
        for what, c in (("substitution", self.sub), ("insertion", self.ins), ("deletion", self.dele)):
            if c is not None and c <= 0:
                raise ValueError(f"the {what} cost must be positive")

    def gaps(self, kind: str) -> list[tuple[int, int]]:
        """(open, extend) of all ways to make a gap of that kind; linear gaps open for free."""
        linear = self.ins if kind == "ins" else self.dele
        return ([(0, linear)] if linear is not None else []) + [(x.open, x.extend) for x in self.layers if x.kind == kind]

    @property
    def is_unit(self) -> bool:
        return (self.sub, self.ins, self.dele, self.layers) == (1, 1, 1, ())

    def sub_cost(self, x: str, y: str) -> int | None:
        return 0 if x == y else self.sub

    def gap_cost(self, delta: int) -> int | None:
        """Of moving to a diagonal delta = (i steps) - (j steps) away: below 0 insertions, above 0 deletions."""
        options = [o + abs(delta) * e for o, e in self.gaps("ins" if delta < 0 else "del")]
        return 0 if delta == 0 else min(options, default=None)

    def extend_cost(self, delta: int) -> int | None:
        """As gap_cost, for gaps that are open already."""
        options = [abs(delta) * e for _, e in self.gaps("ins" if delta < 0 else "del")]
        return 0 if delta == 0 else min(options, default=None)

    def most_for_cost(self, kind: str, cost: int, opened: bool = False) -> int:
        """The longest gap of that kind within cost (opened: of one that is open already)."""
        return max((max(0, cost - (0 if opened else o)) // e for o, e in self.gaps(kind)), default=0)


def lcs() -> CostModel:
    return CostModel("lcs", None, 1, 1)


def unit() -> CostModel:
    return CostModel("unit", 1, 1, 1)


def linear(sub: int, indel: int) -> CostModel:
    return CostModel("linear", sub, indel, indel)


def linear_asymmetric(sub: int, ins: int, dele: int) -> CostModel:
    return CostModel("linear_asymmetric", sub, ins, dele)


def affine(sub: int, open_: int, extend: int) -> CostModel:
    return CostModel("affine", sub, None, None, (Layer("ins", open_, extend), Layer("del", open_, extend)))


def linear_affine(sub: int, indel: int, open_: int, extend: int) -> CostModel:
    return CostModel("linear_affine", sub, indel, indel, (Layer("ins", open_, extend), Layer("del", open_, extend)))


def affine_asymmetric(sub: int, ins_open: int, ins_extend: int, del_open: int, del_extend: int) -> CostModel:
    return CostModel("affine_asymmetric", sub, None, None, (Layer("ins", ins_open, ins_extend), Layer("del", del_open, del_extend)))


def double_affine(sub: int, open1: int, extend1: int, open2: int, extend2: int) -> CostModel:
    pairs = ((open1, extend1), (open2, extend2))
    return CostModel("double_affine", sub, None, None, tuple(Layer(k, o, e) for o, e in pairs for k in ("ins", "del")))


def from_parts(sub: int | None, open_: int, extend: int) -> CostModel:
    """An open cost of 0 makes linear gaps; no substitution cost forbids substitutions."""
    return CostModel("lcs" if sub is None else "linear", sub, extend, extend) if open_ == 0 else affine(sub, open_, extend)


NAMED = {f.__name__: f for f in (lcs, unit, linear, linear_asymmetric, affine, linear_affine, affine_asymmetric, double_affine)}


def named(text: str) -> CostModel:
    """'affine(1,2,1)' and the like."""
    name, _, rest = text.partition("(")
    if name.strip() not in NAMED:
        raise ValueError(f"no cost model {name!r}; there are {', '.join(NAMED)}")
    return NAMED[name.strip()](*(int(x) for x in rest.rstrip(") ").split(",") if x.strip()))
