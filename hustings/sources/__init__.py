"""hustings.sources"""
