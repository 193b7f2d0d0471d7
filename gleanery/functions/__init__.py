"""Scalar functions: Column expressions where Spark has the pieces, small parsers for XML, XPath and lenient dates."""
