"""Operators for preparing training data: each module holds one operator, its query and, where there is one, its SQL."""
