"""Page-conversion analytics on Spark DataFrames.

``functions`` holds column expressions, ``operators`` DataFrame-to-DataFrame
steps, ``plans`` the composed reports, ``sources`` and ``sinks`` the edges,
``streaming`` the unbounded variants.
"""

__version__ = "0.1.0"
