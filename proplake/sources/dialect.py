"""The few spots where Spark SQL and the checking engine spell the same integer arithmetic differently."""

from __future__ import annotations


class Spark:
    name = "spark"

    @staticmethod
    def idiv(a: str, b: object) -> str:
        return f"(({a}) div {b})"

    @staticmethod
    def days(ts: str, n: str) -> str:
        return f"({ts} + make_dt_interval(CAST({n} AS INT)))"

    @staticmethod
    def hours(ts: str, n: str) -> str:
        return f"({ts} + make_dt_interval(0, CAST({n} AS INT)))"


class Duck:
    name = "duck"

    @staticmethod
    def idiv(a: str, b: object) -> str:
        return f"(({a}) // {b})"

    @staticmethod
    def days(ts: str, n: str) -> str:
        return f"({ts} + to_days(CAST({n} AS INTEGER)))"

    @staticmethod
    def hours(ts: str, n: str) -> str:
        return f"({ts} + to_hours(CAST({n} AS INTEGER)))"
