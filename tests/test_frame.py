"""Each operator beside pandas on small frames with missing values, ties and several partitions."""

import numpy as np
import pandas as pd
import pytest

import tessera as ts
from tessera import array as ta

CASES = {}


def case(name, made, wanted, unordered=False):
    CASES[name] = (made, wanted, unordered)


def same(a, b, unordered):
    a = a.compute() if hasattr(a, "compute") else a
    quiet = {"check_dtype": False, "check_names": False, "check_index_type": False, "check_freq": False}
    if isinstance(b, pd.DataFrame):
        a, b = (a.reset_index(drop=True), b.reset_index(drop=True)) if unordered else (a, b)
        pd.testing.assert_frame_equal(a, b, check_column_type=False, **quiet)
    elif isinstance(b, pd.Series):
        a, b = (a.reset_index(drop=True), b.reset_index(drop=True)) if unordered else (a, b)
        if len(a) and a.map(lambda v: isinstance(v, np.ndarray)).any():
            a = a.map(lambda v: list(v) if isinstance(v, np.ndarray) else v)
        pd.testing.assert_series_equal(a, b, **quiet)
    elif isinstance(b, np.ndarray):
        assert np.allclose(a, b)
    else:
        assert a == b or abs(a - b) < 1e-9


@pytest.fixture(scope="module")
def cases(spark):
    CASES.clear()
    build(spark)
    return CASES


def build(spark):
    pdf=pd.DataFrame({'x':[1,2,3,4,5,6,7,8],'y':[1.5,None,2.5,4.0,-1.0,0.0,2.0,2.0],'s':['a','b',None,'a','c','b','a','Zed'],'g':[1,1,2,2,3,3,3,1]})
    df=ts.from_pandas(pdf,npartitions=3)
    case('id',lambda:df,pdf)
    case('filter',lambda:df[(df.x>2)&(df.y<3)],pdf[(pdf.x>2)&(pdf.y<3)])
    case('arith',lambda:df.x*2+df.y,pdf.x*2+pdf.y)
    case('floordiv',lambda:(df.x-5)//3,(pdf.x-5)//3)
    case('mod',lambda:(df.x-5)%3,(pdf.x-5)%3)
    case('assign',lambda:df.assign(z=df.x+1,w=lambda d:d.z*2),pdf.assign(z=pdf.x+1,w=lambda d:d.z*2))
    case('overw',lambda:df.assign(x=df.x+1),pdf.assign(x=pdf.x+1))
    case('sum',lambda:df[['x','y']].sum(),pdf[['x','y']].sum())
    case('mean',lambda:df[['x','y']].mean(),pdf[['x','y']].mean())
    case('std',lambda:df[['x','y']].std(),pdf[['x','y']].std())
    case('ssum',lambda:df.y.sum(),pdf.y.sum())
    case('cumsum',lambda:df.y.cumsum(),pdf.y.cumsum())
    case('cumsumf',lambda:df[['x','y']].cumsum(),pdf[['x','y']].cumsum())
    case('cummax',lambda:df.y.cummax(),pdf.y.cummax())
    case('shift',lambda:df.x-df.x.shift(1),pdf.x-pdf.x.shift(1))
    case('shift-2',lambda:df.x.shift(-2),pdf.x.shift(-2))
    case('shift5',lambda:df.x.shift(5),pdf.x.shift(5))
    case('diff',lambda:df[['x','y']].diff(),pdf[['x','y']].diff())
    case('ffill',lambda:df.ffill(),pdf.ffill())
    case('bfill',lambda:df.y.bfill(),pdf.y.bfill())
    case('ffill1',lambda:df.s.ffill(limit=1),pdf.s.ffill(limit=1))
    case('roll',lambda:df.x.rolling(3).sum(),pdf.x.rolling(3).sum())
    case('rollc',lambda:df[['x','y']].rolling(3,min_periods=1,center=True).mean(),pdf[['x','y']].rolling(3,min_periods=1,center=True).mean())
    case('rollvar',lambda:df.x.rolling(4).var(),pdf.x.rolling(4).var())
    case('rollskew',lambda:df.x.rolling(4).skew(),pdf.x.rolling(4).skew())
    case('rollkurt',lambda:df.y.rolling(6,min_periods=4).kurt(),pdf.y.rolling(6,min_periods=4).kurt())
    case('rollmed',lambda:df.y.rolling(3,min_periods=1).median(),pdf.y.rolling(3,min_periods=1).median())
    case('rollcount',lambda:df.y.rolling(3).count(),pdf.y.rolling(3,min_periods=0).count())
    case('rollapply',lambda:df.x.rolling(3).apply(lambda a:float(np.max(a)-np.min(a))),pdf.x.rolling(3).apply(lambda a:float(np.max(a)-np.min(a)),raw=True))
    case('gsum',lambda:df.groupby('g')[['x','y']].sum(),pdf.groupby('g')[['x','y']].sum())
    case('gmean',lambda:df.groupby('g').y.mean(),pdf.groupby('g').y.mean())
    case('gagg',lambda:df.groupby('g').agg({'x':'sum','y':'max'}),pdf.groupby('g').agg({'x':'sum','y':'max'}))
    case('gfirst',lambda:df.groupby('g').first(),pdf.groupby('g').first())
    case('glast',lambda:df.groupby('g').s.last(),pdf.groupby('g').s.last())
    case('gsize',lambda:df.groupby('s').size(),pdf.groupby('s').size())
    case('gvar',lambda:df.groupby('g')[['x','y']].var(),pdf.groupby('g')[['x','y']].var())
    case('gmedian',lambda:df.groupby('g')[['x','y']].median(),pdf.groupby('g')[['x','y']].median())
    case('gshift',lambda:df.groupby('g').x.shift(1),pdf.groupby('g').x.shift(1))
    case('gcumsum',lambda:df.groupby('g').x.cumsum(),pdf.groupby('g').x.cumsum())
    case('gcumcount',lambda:df.groupby('g').cumcount(),pdf.groupby('g').cumcount())
    case('gtransform',lambda:df.groupby('g').x.transform('mean'),pdf.groupby('g').x.transform('mean'))
    case('gffill',lambda:df.groupby('g').y.ffill(),pdf.groupby('g').y.ffill())
    case('gidx',lambda:df.groupby('g').x.idxmax(),pdf.groupby('g').x.idxmax())
    case('gnunique',lambda:df.groupby('g').s.nunique(),pdf.groupby('g').s.nunique())
    case('ghead',lambda:df.groupby('g').head(1),pdf.groupby('g').head(1))
    case('groll',lambda:df.groupby('g').x.rolling(2).sum(),pdf.groupby('g').x.rolling(2).sum().droplevel(0).sort_index())
    case('gapply',lambda:df.groupby('g').apply(lambda d: pd.DataFrame({'g':[int(d.g.iloc[0])],'v':[float(d.x.sum())]}),meta='g long, v double').sort_values('g'),pdf.groupby('g').x.sum().reset_index().rename(columns={'x':'v'}),True)
    case('merge',lambda:df.merge(ts.from_pandas(pd.DataFrame({'g':[1,2,9],'q':[10,20,90]})),on='g',how='outer').sort_values(['g','x']),pdf.merge(pd.DataFrame({'g':[1,2,9],'q':[10,20,90]}),on='g',how='outer').sort_values(['g','x']),True)
    case('mergenull',lambda:df.merge(ts.from_pandas(pd.DataFrame({'s':['a',None],'q':[10,20]})),on='s').sort_values('x'),pdf.merge(pd.DataFrame({'s':['a',None],'q':[10,20]}),on='s').sort_values('x'),True)
    case('sort',lambda:df.sort_values('y'),pdf.sort_values('y',kind='stable'))
    case('nlargest',lambda:df.nlargest(3,'y').sort_values('x'),pdf.nlargest(3,'y').sort_values('x'),True)
    case('dd',lambda:df.drop_duplicates(subset=['g']),pdf.drop_duplicates(subset=['g']))
    case('ddl',lambda:df.drop_duplicates(subset=['s'],keep='last'),pdf.drop_duplicates(subset=['s'],keep='last'))
    case('vc',lambda:df.s.value_counts(),pdf.s.value_counts().sort_index().sort_values(ascending=False,kind='stable'))
    case('mode',lambda:df.g.mode(),pdf.g.mode(),True)
    case('nunique',lambda:df.nunique(),pdf.nunique())
    case('describe',lambda:df[['x','y']].describe(),pdf[['x','y']].describe())
    case('quant',lambda:df[['x','y']].quantile([.25,.5]),pdf[['x','y']].quantile([.25,.5]))
    case('corr',lambda:df[['x','y','g']].corr(),pdf[['x','y','g']].corr())
    case('cov',lambda:df[['x','y']].cov(),pdf[['x','y']].cov())
    case('idxmax',lambda:df[['x','y']].idxmax(),pdf[['x','y']].idxmax())
    case('query',lambda:df.query('x > 2 and y < 3'),pdf.query('x > 2 and y < 3'))
    case('query2',lambda:df.query('x > @k & g in [1,2]',local_dict={'k':2}),pdf.query('x > 2 & g in [1,2]'))
    case('eval',lambda:df.eval('z = x + y'),pdf.eval('z = x + y'))
    case('fillna',lambda:df.fillna(0),pdf.fillna({'x':0,'y':0}))
    case('clip',lambda:df.x.clip(2,5),pdf.x.clip(2,5))
    case('where',lambda:df.x.where(df.y>0),pdf.x.where(pdf.y>0))
    case('mask',lambda:df.x.mask(df.x>4,0),pdf.x.mask(pdf.x>4,0))
    case('isin',lambda:df.s.isin(['a','b']),pdf.s.isin(['a','b']))
    case('mapd',lambda:df.s.map({'a':1,'b':2}),pdf.s.map({'a':1,'b':2}))
    case('apply',lambda:df.apply(lambda r:float(r.x+r.g),axis=1),pdf.apply(lambda r:float(r.x+r.g),axis=1))
    case('rename',lambda:df.rename(columns={'x':'xx'}),pdf.rename(columns={'x':'xx'}))
    case('reset',lambda:df[df.x>3].reset_index(drop=True),pdf[pdf.x>3].reset_index(drop=True))
    case('setidx',lambda:df.set_index('x'),pdf.set_index('x'))
    case('loc',lambda:df.loc[2:4],pdf.loc[2:4])
    case('head',lambda:df.head(3),pdf.head(3))
    case('tail',lambda:df.tail(3),pdf.tail(3))
    case('pivot',lambda:df.pivot_table(index='g',columns='s',values='x',aggfunc='sum'),pdf.pivot_table(index='g',columns='s',values='x',aggfunc='sum'))
    case('melt',lambda:df.melt(id_vars=['g'],value_vars=['x','y']).sort_values(['variable','g','value']),pdf.melt(id_vars=['g'],value_vars=['x','y']).sort_values(['variable','g','value']),True)
    case('concat',lambda:ts.concat([df,df.assign(n=df.x)]),pd.concat([pdf,pdf.assign(n=pdf.x)]))
    other=pd.Series([10.,20.,30.],index=[2,3,99],name='o'); so=ts.from_pandas(other)
    case('align',lambda:df.x+so,pdf.x+other)
    case('alignassign',lambda:df.assign(o=so),pdf.assign(o=other))
    case('combf',lambda:df[['x','y']].combine_first(ts.from_pandas(pd.DataFrame({'y':[9.,9.],'q':[1.,2.]},index=[1,50]))),pdf[['x','y']].combine_first(pd.DataFrame({'y':[9.,9.],'q':[1.,2.]},index=[1,50]))[['x','y','q']])
    for d in ['backward','forward','nearest']:
        L=pd.DataFrame({'a':[1,5,10],'lv':['a','b','c']}); R=pd.DataFrame({'a':[1,2,3,6,7],'rv':[1,2,3,6,7]})
        case('asof'+d,lambda L=L,R=R,d=d:ts.merge_asof(ts.from_pandas(L),ts.from_pandas(R),on='a',direction=d),pd.merge_asof(L,R,on='a',direction=d),True)
        case('asofx'+d,lambda L=L,R=R,d=d:ts.merge_asof(ts.from_pandas(L),ts.from_pandas(R),on='a',direction=d,allow_exact_matches=False,tolerance=3),pd.merge_asof(L,R,on='a',direction=d,allow_exact_matches=False,tolerance=3),True)
    t=pd.DataFrame({'v':range(12),'w':1.0},index=pd.date_range('2000-01-01',periods=12,freq='min')); t=t.drop(t.index[4:9]); tt=ts.from_pandas(t)
    case('resample',lambda:tt.resample('2min').sum(),t.resample('2min').sum())
    case('resmean',lambda:tt.resample('3min').mean(),t.resample('3min').mean())
    case('resr',lambda:tt.v.resample('2min',closed='right',label='right').count(),t.v.resample('2min',closed='right',label='right').count())
    case('ohlc',lambda:tt.v.resample('4min').ohlc(),t.v.resample('4min').ohlc())
    case('rollt',lambda:tt.v.rolling('3min').sum(),t.v.rolling('3min').sum())
    case('locdt',lambda:tt.loc['2000-01-01 00:01':'2000-01-01 00:03'],t.loc['2000-01-01 00:01':'2000-01-01 00:03'])
    dates=pd.Series(pd.to_datetime(['2020-02-29 13:45:30.123456','2021-12-31 23:59:59','2020-01-01'],format='mixed')); ds=ts.from_pandas(dates)
    for m in ['year','month','day','hour','minute','second','quarter','dayofweek','dayofyear','days_in_month','is_leap_year','is_month_start','is_month_end','is_quarter_start','is_quarter_end','is_year_start','is_year_end','microsecond']:
        case('dt.'+m,lambda m=m:getattr(ds.dt,m),getattr(dates.dt,m))
    for f in ['h','15min','D']:
        for m in ['floor','ceil','round']: case(f'dt.{m}{f}',lambda m=m,f=f:getattr(ds.dt,m)(f),getattr(dates.dt,m)(f))
    case('isocal',lambda:ds.dt.isocalendar(),dates.dt.isocalendar())
    case('strftime',lambda:ds.dt.strftime('%Y-%m-%dT%H:%M'),dates.dt.strftime('%Y-%m-%dT%H:%M'))
    case('dayname',lambda:ds.dt.day_name(),dates.dt.day_name())
    ss=pd.Series(['a b c','Hello World',None,'  x ','foo123','ÀÉ','a1b2','-12','aXbXc']); st=ts.from_pandas(ss)
    for m,a in [('capitalize',()),('lower',()),('upper',()),('len',()),('center',(8,'*')),('ljust',(8,)),('rjust',(8,)),('zfill',(6,)),('contains',('o',)),('match',('[a-z]',)),('fullmatch',('[a-z0-9 ]+',)),('startswith',('a',)),('endswith',('c',)),('count',('[a-z]',)),('find',('b',)),('rfind',('X',)),('findall',('[a-z]',)),('get',(1,)),('slice',(1,3)),('slice_replace',(1,2,'_')),('isalnum',()),('isalpha',()),('isdigit',()),('isspace',()),('islower',()),('isupper',()),('istitle',()),('strip',()),('lstrip',()),('rstrip',()),('removeprefix',('a',)),('removesuffix',('c',)),('repeat',(2,)),('replace',('b','B')),('title',()),('swapcase',()),('casefold',()),('join',('-',)),('split',('X',)),('rsplit',('X',1)),('split',()),('pad',(6,'both','.'))]:
        b=getattr(ss.str,m)(*a) if m not in('rsplit',) else ss.str.rsplit('X',n=1)
        if m in('isalnum','isalpha','isdigit','isspace','islower','isupper','istitle'): b=b.where(ss.notna(),None)
        case('str.'+m+str(a),lambda m=m,a=a:getattr(st.str,m)(*a),b)
    case('partition',lambda:st.str.partition('X'),ss.str.partition('X').rename(columns=str))
    case('rpart',lambda:st.str.rpartition('X'),ss.str.rpartition('X').rename(columns=str))
    case('extract',lambda:st.str.extract('([a-z])([0-9])'),ss.str.extract('([a-z])([0-9])').rename(columns=str))
    case('splitx',lambda:st.str.split('X',n=1,expand=True),ss.str.split('X',n=1,expand=True).rename(columns=str))
    case('cat',lambda:st.str.cat(st,sep='|'),ss.str.cat(ss,sep='|'))
    pc=pd.DataFrame({'a':[1,2,3],'c':pd.Categorical(['x','y','x'],categories=['x','y','z'])}); dc=ts.from_pandas(pc)
    case('codes',lambda:dc.c.cat.codes,pc.c.cat.codes)
    case('dummies',lambda:ts.get_dummies(dc),pd.get_dummies(pc))
    case('unused',lambda:dc.c.cat.remove_unused_categories(),pc.c.cat.remove_unused_categories())
    case('sqrt',lambda:np.sqrt(df.x),np.sqrt(pdf.x)); case('maximum',lambda:np.maximum(df.x,3),np.maximum(pdf.x,3))
    case('rowsum',lambda:df[['x','y']].sum(axis=1),pdf[['x','y']].sum(axis=1))
    case('rowvar',lambda:df[['x','g']].var(axis=1),pdf[['x','g']].var(axis=1))
    case('frameadd',lambda:df[['x','g']]+1,pdf[['x','g']]+1)
    case('addfill',lambda:df.y.add(1,fill_value=0),pdf.y.add(1,fill_value=0))
    case('explode',lambda:ts.from_spark(spark.createDataFrame([(1,[1,2]),(2,[])],'a int, l array<int>')).explode('l').sort_values(['a','l']),pd.DataFrame({'a':[1,1,2],'l':[1,2,None]}),True)
    case('mono',lambda:df.x.is_monotonic_increasing,True)
    case('autocorr',lambda:df.x.autocorr(1),pdf.x.autocorr(1))
    case('mapov',lambda:df[['x']].map_overlap(lambda d:d.rolling(3).sum(),2,0,meta='x double').sort_values('x'),pdf[['x']].rolling(3).sum().sort_values('x'),True)
    A = np.arange(12.0).reshape(3, 4)
    a = ta.from_array(A)
    for name, x, y in [("sum", a.sum(0), A.sum(0)), ("std", a.std(1, ddof=1), A.std(1, ddof=1)), ("T", a.T, A.T), ("slice", a[1:, ::2], A[1:, ::2]), ("broadcast", a + ta.from_array(A[0]), A + A[0]), ("dot", a.dot(a.T), A.dot(A.T)), ("moment", a.moment(2), ((A - A.mean()) ** 2).mean(keepdims=True)[0]), ("argmax", a.argmax(1), A.argmax(1)), ("ones", ta.ones((2, 3)), np.ones((2, 3))), ("linspace", ta.linspace(0, 1, 5), np.linspace(0, 1, 5))]:
        case("array." + name, lambda x=x: x.compute(), y)


def test_like_pandas(cases):
    wrong = {}
    for name, (made, wanted, unordered) in cases.items():
        try:
            same(made(), wanted, unordered)
        except Exception as e:  # all cases are tried before any is reported
            wrong[name] = f"{type(e).__name__}: {str(e)[:300]}"
    assert not wrong, wrong


def test_whole_numbers_beyond_doubles(spark):
    a, b = [2**60 + 1, -(2**60) - 1, 7, -7, 0, 2**62], [10, 2, -3, 3, 4, -7]
    df = ts.from_pandas(pd.DataFrame({"a": a, "b": b}), npartitions=2)
    assert [int(x) for x in (df.a % df.b).compute()] == [x % y for x, y in zip(a, b, strict=True)]
    whole = (df.a // df.b).base.sdf.select((df.a // df.b).col.alias("q")).collect()
    assert sorted(r.q for r in whole) == sorted(x // y for x, y in zip(a, b, strict=True))
    f = ts.from_pandas(pd.DataFrame({"x": [7.5, -7.5, 1.0], "y": [2.0, 2.0, 0.0]}), npartitions=1)
    assert (f.x % f.y).compute().tolist()[:2] == [1.5, 0.5] and (f.x // f.y).compute().tolist()[:2] == [3.0, -4.0]


def test_one_missing_value_without_skipping(spark):
    pdf = pd.DataFrame({"x": [1.0, None, 3.0, 4.0], "y": [1.0, 2.0, 3.0, 4.0]})
    df = ts.from_pandas(pdf, npartitions=2)
    for how in ("sum", "prod", "mean", "min", "max", "var", "std"):
        assert pd.isna(getattr(df.x, how)(skipna=False).compute()) and getattr(df.y, how)(skipna=False).compute() == pytest.approx(getattr(pdf.y, how)())
        assert getattr(df, how)(skipna=False).compute().isna().tolist() == [True, False]
    for how in ("cumsum", "cumprod", "cummin", "cummax"):
        pd.testing.assert_series_equal(getattr(df.x, how)(skipna=False).compute(), getattr(pdf.x, how)(skipna=False), check_names=False, check_index_type=False)
        pd.testing.assert_frame_equal(getattr(df, how)(skipna=False).compute(), getattr(pdf, how)(skipna=False), check_index_type=False)
    assert df.sum(axis=1, skipna=False).compute().isna().tolist() == [False, True, False, False]


def test_what_a_function_leaves_undefined_is_missing(spark):
    root = np.sqrt(ts.from_pandas(pd.DataFrame({"x": [-1.0, 4.0, 9.0]}), npartitions=1).x)
    assert (root.sum().compute(), root.count().compute(), root.max().compute(), root.mean().compute()) == (5.0, 2, 3.0, 2.5)


@pytest.mark.parametrize("before, after", [(1, 0), (0, 2), (40, 3), (200, 200)])
def test_halos_reach_as_far_as_asked(spark, before, after):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tessera.operators import ordered

    df = spark.range(100).select((F.col("id") * 7 % 101).alias("k"))
    got = ordered.neighbours(df, {"n": lambda w: F.sum("k").over(w.rowsBetween(-before, after))}, ["k"], before, after)
    want = df.withColumn("n", F.sum("k").over(Window.orderBy("k").rowsBetween(-before, after)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
