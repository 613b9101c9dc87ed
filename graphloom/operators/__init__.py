"""Graph operators over plain node and edge DataFrames."""
