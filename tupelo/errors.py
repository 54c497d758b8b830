"""What can be wrong with a query, a schema or its data."""


class TupeloError(Exception):
    """Base of this package's errors."""


class ParseError(TupeloError):
    """A text that the grammar doesn't accept, with the place where it stops fitting."""

    def __init__(self, line: int, column: int, message: str):
        super().__init__(f"line {line}, column {column}: {message}")
        self.line, self.column, self.message = line, column, message


class AnalysisError(TupeloError):
    """A query that parses but has no meaning over the catalog."""


class CatalogError(TupeloError):
    """A table, schema or statistics file that is missing or malformed."""
