"""Statements built from clauses, in any order of calls; values are bound and never become text.

    Statement.select("id", "name").of("t").where("dept = ?", 3).order("name").run(session)
    Statement.insert("t", "id", "name").values(1, "O'Neil").run(session)
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera import dialect as D
from tessera.sql import Session

#: Clauses in the order of the text: what stands before the first of them, and between two.
_CLAUSES = {"of": (" FROM ", ", "), "set": (" SET ", ", "), "join": (" ", " "), "values": (" VALUES ", ", "), "where": (" WHERE ", " AND "), "group": (" GROUP BY ", ", "), "having": (" HAVING ", " AND "), "order": (" ORDER BY ", ", "), "limit": (" LIMIT ", ""), "offset": (" OFFSET ", ""), "returning": (" RETURNING ", ", ")}


class Statement:
    """A SELECT, INSERT, UPDATE or DELETE. ``?`` outside strings stands for a bound value. Every method returns a new
    statement, so that a common beginning can be shared."""

    def __init__(self, head: str, clauses: dict[str, list[tuple[str, tuple]]] | None = None):
        self.head, self.clauses = head, clauses or {}

    @classmethod
    def select(cls, *columns: str) -> Statement:
        return cls(f"SELECT {', '.join(columns) or '*'}")

    @classmethod
    def insert(cls, table: str, *columns: str) -> Statement:
        return cls(f"INSERT INTO {table}" + (f" ({', '.join(columns)})" if columns else ""))

    @classmethod
    def update(cls, table: str) -> Statement:
        return cls(f"UPDATE {table}")

    @classmethod
    def delete(cls, table: str) -> Statement:
        return cls(f"DELETE FROM {table}")

    def _with(self, clause: str, text: str, *values: object) -> Statement:
        marks = sum(t == D.Token("op", "?") for t in D.tokens(text))
        if marks != len(values):
            raise ValueError(f"{marks} marks and {len(values)} values: {text}")
        return Statement(self.head, self.clauses | {clause: [*self.clauses.get(clause, []), (text, values)]})

    def of(self, table: str) -> Statement:
        return self._with("of", table)

    def join(self, table: str, on: str, *values: object, how: str = "inner") -> Statement:
        return self._with("join", f"{how.upper()} JOIN {table} ON {on}", *values)

    def where(self, condition: str, *values: object) -> Statement:
        """Several conditions hold all at once."""
        return self._with("where", f"({condition})", *values)

    def equal(self, column: str, value: object) -> Statement:
        return self.where(f"{column} IS NULL") if value is None else self.where(f"{column} = ?", value)

    def group(self, *keys: str) -> Statement:
        return self._with("group", ", ".join(keys))

    def having(self, condition: str, *values: object) -> Statement:
        return self._with("having", f"({condition})", *values)

    def order(self, *keys: str) -> Statement:
        return self._with("order", ", ".join(keys))

    def limit(self, n: int) -> Statement:
        return self._once("limit", n)

    def offset(self, n: int) -> Statement:
        return self._once("offset", n)

    def _once(self, clause: str, n: int) -> Statement:
        return Statement(self.head, self.clauses | {clause: [(str(int(n)), ())]})

    def values(self, *row: object) -> Statement:
        return self._with("values", f"({', '.join('?' * len(row))})", *row)

    def set(self, column: str, value: object) -> Statement:
        return self._with("set", f"{column} = ?", value)

    def set_to(self, column: str, expression: str, *values: object) -> Statement:
        return self._with("set", f"{column} = {expression}", *values)

    def returning(self, *columns: str) -> Statement:
        return self._with("returning", ", ".join(columns))

    def build(self) -> tuple[str, list]:
        """The text with numbered parameters, and their values."""
        out, args = [self.head], []
        for clause, (before, between) in _CLAUSES.items():
            for n, (text, values) in enumerate(self.clauses.get(clause, [])):
                left = iter(values)
                out.append(between if n else before)
                for t in D.tokens(text):
                    if t == D.Token("op", "?"):
                        args.append(next(left))
                        out.append(f"${len(args)}")
                    else:
                        out.append(t.text)
        return "".join(out), args

    def run(self, session: Session) -> DataFrame | None:
        text, args = self.build()
        return session.execute(text, args or None)
