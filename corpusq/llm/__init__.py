"""Training-data operators.  Nothing outside this subpackage imports it.

``corpusq.llm.queries`` holds the registered queries; every operator lives in
a module of its own and can be used on any DataFrame.
"""
