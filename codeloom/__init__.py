"""codeloom: code and text analytics expressed as Spark DataFrame plans.

The core never imports ``codeloom.llm``; that subpackage may be absent.
"""

__version__ = "0.1.0"
