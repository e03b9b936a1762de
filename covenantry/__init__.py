"""Document-obligation analytics as PySpark DataFrame operators.

Layout
------
``schema``     enum domains, ordered ranks and table schemas
``rules``      the rule base (domains, keywords, weights) as plain parameters
``functions``  Column builders and the few Arrow UDFs
``operators``  ``DataFrame(s) -> DataFrame`` operators
``sources``    readers, parsers and writers
``plans``      multi-stage dataflows built from the operators
``streaming``  Structured Streaming jobs
``catalog``    the registered queries with their SQL oracles
"""

__version__ = "0.1.0"
