"""Operators for preparing training data at scale.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; ``queries`` binds the operators to the tables of the
check data and holds the SQL for what SQL can express.
"""
