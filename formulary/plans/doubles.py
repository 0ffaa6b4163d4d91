"""Deterministic stand-ins for models and remote clients, used by registered queries and tests."""

from __future__ import annotations

from formulary.operators.generation import Client, Model, Reply, RetryPolicy


def load_echo() -> Model:
    return lambda prompts: [f"echo: {p}" for p in prompts]


def load_last_turn() -> Model:
    """Answers with the text of the last chat message."""
    return lambda prompts: ["𝜙=" + p.rsplit("|>\n", 1)[1] for p in prompts]


def flaky_client() -> Client:
    """Fails as often as the sentence length modulo 4 says; says nothing about Brand 7."""
    seen: dict[str, int] = {}

    def call(system: str, user: str) -> Reply:
        seen[user] = seen.get(user, 0) + 1
        if seen[user] <= len(user) % 4:
            raise ConnectionError("busy")
        if user.endswith("Brand 7."):
            return Reply("", "thinking")
        return Reply(f"𝜙={len(system)}")

    return call


def steady_client() -> Client:
    return lambda system, user: Reply(f"fallback {len(system)}")


NO_WAIT = RetryPolicy(attempts=3, threads=4, sleep=lambda _: None)
