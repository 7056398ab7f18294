"""Specs that chain operators: named views and recipes."""
