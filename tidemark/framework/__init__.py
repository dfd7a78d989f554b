"""Point-in-time features, estimators, stored artifacts and views.

Raw rows are visible strictly before `as_of`, derived tables at or before it. Functions that users supply never see `as_of`.
"""
