"""Periodic-signal and sequence analytics as Spark DataFrame operators.

Every public function takes DataFrames and parameters and returns a lazy
DataFrame (or a Column, in ``functions``); nothing keeps global state.
"""
