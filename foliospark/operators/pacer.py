"""Waiting between calls, as the headers of the last answer ask."""

from __future__ import annotations

import time
from collections.abc import Callable

from ..config import REQUESTS_SAFETY_MARGIN, TOKENS_SAFETY_MARGIN
from ..functions.rates import (
    DEFAULT_TOKENS_PER_MINUTE, H_LEFT_REQUESTS, H_LEFT_TOKENS, H_LIMIT_REQUESTS, H_LIMIT_TOKENS, H_RESET_TOKENS, LOW_QUOTA_DELAY, MIN_DELAY,
)


class Pacer:
    """One task's share of a quota.

    All tasks of a run draw on the same quota, and every answer says what is left of it.  A task counts on its share of
    that only, less what it has sent since, and on its share of the rate; the next answer deals the quota out anew.
    """

    def __init__(self, tasks: int = 1, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        self.tasks, self.clock, self.sleep = max(1, tasks), clock, sleep
        self.known = self.waited = None
        self.counts, self.reset, self.at = {}, 0.0, 0.0

    def answered(self, headers: dict) -> None:
        """Read the headers of an answer; a count that is no number makes all of them unknown."""
        low = {str(k).lower(): v for k, v in (headers or {}).items()}
        names = {"limit": H_LIMIT_TOKENS, "left": H_LEFT_TOKENS, "requests": H_LEFT_REQUESTS, "most": H_LIMIT_REQUESTS}
        self.at = self.clock()
        try:
            self.counts = {k: int(low.get(h) or 0) for k, h in names.items()}
        except ValueError:
            self.known = False
            return
        self.known = any(h in low for h in (*names.values(), H_RESET_TOKENS))
        try:
            self.reset = self.at + float(low[H_RESET_TOKENS])
        except (KeyError, TypeError, ValueError):
            self.reset = self.at + 60.0

    def delay(self, tokens: int) -> float:
        """Seconds to wait before a call of so many tokens; the first rule that applies wins."""
        now = self.clock()
        if not self.known:
            return MIN_DELAY
        left, ahead = self.counts["left"] // self.tasks, self.reset - now
        limit = self.counts["limit"] if self.counts["limit"] > 0 else DEFAULT_TOKENS_PER_MINUTE
        safe = limit / self.tasks / 60.0 * 0.8
        if left < tokens and ahead > 0:
            return min(ahead, 60.0)
        if left < tokens + TOKENS_SAFETY_MARGIN // self.tasks and ahead > 0:
            return min(max(ahead * 0.1, 1.0), 10.0)
        if self.counts["limit"] > 0 and now - self.at < 1.0 and tokens > safe:
            return min(tokens / safe - 1.0, 2.0)
        if 0 <= self.counts["requests"] // self.tasks < REQUESTS_SAFETY_MARGIN // self.tasks:
            return LOW_QUOTA_DELAY
        return MIN_DELAY

    def before(self, tokens: int) -> None:
        """Wait, unless this is the first call, and take the tokens out of what is left."""
        if self.known is not None:
            self.waited = self.delay(tokens)
            if self.waited > 0:
                self.sleep(self.waited)
        if self.known:
            self.counts["left"] -= tokens * self.tasks
