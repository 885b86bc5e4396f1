"""Operators for preparing training data at corpus scale.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
