"""pathloom: keyed-path tables, lookups, candidate hunts and a versioned catalog on PySpark."""

__version__ = "0.1.0"
