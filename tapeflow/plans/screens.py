"""The seven named screens (Q1–Q7) as specs of one ``screen`` operator."""

from __future__ import annotations

from tapeflow.operators.screens import ScreenSpec

VOLATILE_LIMIT_UP = ScreenSpec("volatile_limit_up", 1.5, 25, 5,
                               locked_by="open", at_limit=True)
SMART_MONEY_SHORT = ScreenSpec("smart_money_short", 1.5, 15, 5,
                               locked_by="open", at_limit=False)
SMART_MONEY_OFF_LIMIT = ScreenSpec("smart_money_off_limit", 1.2, 20, 10, 40,
                                   at_limit=False, drop_base=True,
                                   confirm="persistence", min_hits=3)
SMART_MONEY_AT_LIMIT = ScreenSpec("smart_money_at_limit", 1.5, 20, 10, 50,
                                  at_limit=True, drop_base=True,
                                  confirm="persistence", min_hits=3)
DIVERGENCE_AT_LIMIT = ScreenSpec("divergence_at_limit", 1, 15, 5,
                                 at_limit=True, confirm="divergence")
DIVERGENCE_OFF_LIMIT = ScreenSpec("divergence_off_limit", 1, 15, 5,
                                  at_limit=False, confirm="divergence")
CANDLE_CANDIDATES = ScreenSpec("candle_candidates", 1.5, 15, 10,
                               at_limit=False, confirm="persistence",
                               min_hits=3, strict_hits=True, unlocked_history=True)

SPECS = {s.name: s for s in (
    VOLATILE_LIMIT_UP, SMART_MONEY_SHORT, SMART_MONEY_OFF_LIMIT, SMART_MONEY_AT_LIMIT,
    DIVERGENCE_AT_LIMIT, DIVERGENCE_OFF_LIMIT, CANDLE_CANDIDATES)}
