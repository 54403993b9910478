"""What a query can be rejected for while it is compiled. Errors of data are raised by Spark while it runs."""


class QueryError(ValueError):
    """Base of all rejections."""


class UnsupportedOperator(QueryError):
    pass


class UnsupportedStage(QueryError):
    pass


class InvalidStructure(QueryError):
    pass


class InvalidStage(QueryError):
    pass


class InvalidArgument(QueryError):
    pass


class InvalidUpdate(QueryError):
    pass


class MixedProjection(QueryError):
    pass


class ExpectedNumeric(QueryError):
    pass


class ExpectedDocument(QueryError):
    pass


class ChangeStreamFatalError(QueryError):
    pass


class ObjectTooLarge(QueryError):
    pass
