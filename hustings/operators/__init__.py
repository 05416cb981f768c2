"""hustings.operators"""
