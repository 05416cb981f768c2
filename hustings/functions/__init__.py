"""hustings.functions"""
