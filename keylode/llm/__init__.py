"""Training-data operators: ten corpus operations, each built by one named method.

Nothing outside this subpackage imports it.  ``registry`` lists the queries.
"""
