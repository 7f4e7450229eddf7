"""Vocabularies of the known domains. A corpus is comparable only under the same words."""

from __future__ import annotations

from dataclasses import dataclass, field

CONNECTIVES = ("from", "with", "in", "on", "to", "at")
STEP = r"\bstep\s+\d+\b"
TURN = r"\bturn\s+\d+\b"
STAMP = r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\b"

RECEPTACLES = tuple(
    "armchair bathtubbasin bed cabinet coffeemachine coffeetable countertop desk diningtable drawer dresser fridge garbagecan "
    "handtowelholder laundryhamper microwave ottoman safe shelf sidetable sinkbasin sofa stoveburner toilet toiletpaperhanger "
    "towelholder tvstand".split()
)
VERBS = ("go to", "take", "put", "open", "close", "toggle", "heat", "cool", "clean", "examine", "look", "inventory", "use", "move", "slice")


@dataclass(frozen=True)
class Profile:
    """What a domain's actions and observations are read by."""

    domain: str
    sensitive: dict[str, tuple[str, ...]] = field(default_factory=dict)  # tool ('*': any) to argument names
    classified: tuple[str, ...] = ()  # arguments whose value is classed as an e-mail address
    verbs: tuple[str, ...] = ()
    connectives: tuple[str, ...] = CONNECTIVES
    receptacles: tuple[str, ...] = ()
    whitelist: tuple[str, ...] = ()
    volatile: tuple[str, ...] = ()


DEFAULT = Profile("default")
PROFILES = {
    p.domain: p
    for p in (
        Profile("alfworld", verbs=VERBS, receptacles=RECEPTACLES, volatile=(STEP, TURN, STAMP)),
        Profile("tau2_retail", sensitive={"find_user_id_by_email": ("email",), "*": ("email",)}, classified=("email",), connectives=(), volatile=(TURN, STAMP)),
        Profile("tau2_telecom", sensitive={"*": ("email",)}, classified=("email",), connectives=(), volatile=(TURN, STAMP)),
        Profile("ssb_verified", connectives=(), volatile=(STEP, STAMP)),
        DEFAULT,
    )
}


def profile(domain: str) -> Profile:
    """The domain's vocabulary, or the default one."""
    return PROFILES.get(domain, DEFAULT)


def domains() -> list[str]:
    return sorted(PROFILES)
